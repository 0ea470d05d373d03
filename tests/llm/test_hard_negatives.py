import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from personae.llm import hard_negatives
from personae.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, score string, grp string"


def brute(rows, divisor=100, positives=5, negatives=10, scale=256):
    """The contract, row by row, in whole numbers of Python."""
    use = [
        (i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
        if i is not None and label is not None and v
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (anchor, av, label) in enumerate(use):
        if anchor % divisor:
            continue
        scored = [
            (-sum(x * y for x, y in zip(av, v, strict=True)), i, own) for b, (i, v, own)
            in enumerate(use) if b != a and len(v) == len(av)
        ]
        near = sorted((s, i) for s, i, own in scored if own == label)[:positives]
        for p, positive in near:
            hard = sorted(
                (s, i) for s, i, own in scored if own != label and 30 * p >= 100 * s >= 90 * p
            )
            out += [
                (anchor, positive, r + 1, i, -p, -s) for r, (s, i) in enumerate(hard[:negatives])
            ]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = [
        (i, [float(x) for x in rng.normal(0, 0.4, 70)], int(rng.integers(0, 3)))
        for i in range(600)
    ]
    out += [(700 + i, out[100][1], 1 + i % 2) for i in range(60)]  # copies, ties
    out += [(200, out[5][1], 1), (200, out[200][1], out[200][2]), (300, out[300][1], 0)]
    out += [(1000, None, 1), (1100, [], 1), (1200, [math.nan] * 70, 1), (1300, out[1][1], None)]
    out += [(1400, [None] + [1.0] * 69, 2), (None, out[2][1], 1), (1500, [math.inf] * 70, 0)]
    out += [(1600, [0.0] * 70, 1), (1700, [0.5, 0.25], 1), (1701, [0.5, 0.5], 1)]
    return out + [(1702, [0.25, 0.25], 2), (1800, [1.0], 9)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("group", [5_000, hard_negatives.GROUP])
def test_equals_plain_search(spark, rows, group):
    got = hard_negatives.mine(frame(spark, rows).repartition(3), group=group).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50, [float(x) for x in rng.normal(3e6, 1e6, 5)], i % 2) for i in range(12)]
    got = hard_negatives.mine(frame(spark, rows)).collect()
    assert got and sorted(map(tuple, got)) == brute(rows)


def test_components_beyond_any_score(spark):
    rows = [(100, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e150, 2.0], 2), (3, [2.0, 2.0], 2)]
    got = hard_negatives.mine(frame(spark, rows)).collect()
    assert {(r.anchor_id, r.positive_id) for r in got} <= {(100, 1)}


def test_empty_and_lonely_rows(spark, rows):
    df = frame(spark, rows)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(frame(spark, [(100, [1.0, 2.0], 1)])).count() == 0


def test_primes_cover_the_range():
    assert math.prod(hard_negatives.primes(70_000)) > 140_000
    found = hard_negatives.primes(10**38)
    assert math.prod(found) > 2 * 10**38 and len(set(found)) == len(found)
    assert all(p % q for p in found for q in range(2, p))
    assert hard_negatives.INNER * (hard_negatives.LARGEST // 2) ** 2 < 1 << 24


@pytest.mark.parametrize("size", [40, 3_000, 10**7])
def test_product_is_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size + 1, (n, 130)).astype(np.float64) for n in (9, 17))
    moduli = hard_negatives.primes(130 * size * size)
    got = hard_negatives.product(
        hard_negatives.residues(a, moduli), hard_negatives.residues(b, moduli), moduli
    )
    want = a.astype(int).astype(object) @ b.astype(int).astype(object).T
    assert (got == want).all()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(SF, 'embeddings.parquet')}'")
    want = con.execute(SQL["op11_hard_negatives"]).fetchall()
    got = QUERIES["op11_hard_negatives"](spark, SF).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
