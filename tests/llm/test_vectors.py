import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from personae.llm import forest, topk

SF = "/root/testdata/sf0.1/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<double>, score string"


@pytest.fixture(scope="module")
def rows():
    """Ids, vectors: ties, repeated ids and rows, nulls, odd numbers, two dimensions."""
    rng = np.random.default_rng(2)
    out = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(300)]
    out += [(300 + i, out[7][1]) for i in range(30)]  # copies
    out += [(20, out[3][1]), (40, out[40][1]), (40, out[40][1])]
    out += [(400, None), (420, []), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [math.nan] * 6)]
    out += [(480, [math.inf] + [0.0] * 5), (500, [0.0] * 6), (None, [1.0] * 6)]
    out += [(i, [0.1 * i, 1.0]) for i in (600, 601, 620)]
    return out


def valid(rows):
    return [
        (i, v) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]


def brute(rows, divisor, k, score):
    """(query id, rank, id, score) of every query row, in plain Python."""
    out = []
    for a, (q, qv) in enumerate(rows):
        if q % divisor:
            continue
        scored = [
            (-score(qv, v), i) for b, (i, v) in enumerate(rows) if b != a and len(v) == len(qv)
        ]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def whole(a, b):
    return sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("shard", [50, 16_384])
def test_top_k_is_exact(spark, rows, shard):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got = topk.top_k(df, k=20, divisor=20, block=16, shard=shard).collect()
    assert sorted(map(tuple, got)) == brute(valid(rows), 20, 20, whole)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e7, 3.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [-1e7, 0.5]), (20, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = topk.top_k(df, k=3, divisor=20).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20, 3, whole)


def test_empty_tables(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).limit(0)
    assert topk.top_k(df).count() == 0 and forest.nearest(df).count() == 0


def test_forest_over_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(2)
    got = forest.nearest(df, k=5, divisor=50).collect()  # so few rows are all candidates
    some = [r for r in valid(rows) if any(r[1])]
    want = brute(some, 50, 5, lambda a, b: forest.cosine(np.array(a), np.array(b)))
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [w[:3] for w in want]
    scores = {(r.query_id, r.rank): r.score for r in got}
    assert all(abs(scores[w[:2]] - w[3]) < 1e-12 for w in want)


def test_forest_finds_copies_of_the_query(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = [r for r in forest.nearest(df, divisor=50, least=10).collect() if r.query_id == 300]
    assert [r.vec_id for r in got] == [7, 301, 302, 303, 304]
    assert all(r.score == pytest.approx(1, abs=1e-12) for r in got)


def test_recall(spark):
    table = pq.read_table(SF).to_pylist()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[ids % 50 == 0] @ unit.T
    near[np.arange(len(near)), np.flatnonzero(ids % 50 == 0)] = -9
    best = {
        q: set(ids[np.argsort(-row)[:5]]) for q, row in zip(ids[ids % 50 == 0], near, strict=True)
    }
    got = forest.nearest(spark.read.parquet(SF)).collect()
    found = sum(r.vec_id in best[r.query_id] for r in got)
    assert len(got) == 5 * len(best) and found / len(got) >= 0.9
