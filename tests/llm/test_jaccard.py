import random
import re

import pytest

from personae.llm import jaccard
from personae.llm.components import components


def shingles(text, n=5):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return set()
    width = min(n, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows):
    """(id, set size, smallest id reachable) of each row; null ids last."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [j for b, (j, _) in enumerate(rows) if root(b) == root(a) and j is not None]
        out.append((i, len(sets[a]), min(ids) if ids and sets[a] else i))
    return out


def corpus(seed, near):
    """Random texts, a chain of ever more edited copies, a large group of near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: rng.choices(words, k=n)
    out = [" ".join(text(rng.choice([1, 3, 4, 5, 6, 40, 80, 120]))) for _ in range(60)]
    passage = " ".join(text(30))
    out += [f"{passage} {' '.join(text(20))}" for _ in range(30)]
    base = text(120)
    for _ in range(near):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    chain = text(100)
    for k in range(12):
        chain = [*chain[:-1], f"end{k}"] if k % 2 else [f"start{k}", *chain[1:], f"more{k}"]
        out.append("  ".join(chain).upper())
    out += [out[0], out[3], out[3], "", " \n", None, "É é", "é É", "Solo", "sOLO", "a b c", "A\tB\x0bc"]
    ids = list(range(1000, 1000 + len(out)))
    rng.shuffle(ids)
    return [*zip(ids, out, strict=True), (None, out[5]), (None, "only here"), (ids[0], out[9])]


@pytest.mark.parametrize("near,block", [(40, 128), (150, 16)])
def test_equals_brute_force(spark, near, block):
    rows = corpus(near, near)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string")
    got = jaccard.join(df.repartition(3), block=block)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    mine = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key)
    assert mine == sorted(brute(rows), key=key)


def test_empty_table_and_nothing_to_link(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).drop("component").collect())) == [(1, 2, 1), (2, 0, 2)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_prefix_is_long_enough():
    for n in range(1, 200):
        need = -(-80 * n // 100)  # shingles that any partner shares
        assert jaccard.prefix_length(n, 80) + need == n + 1


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert {r.node: r.root for r in got.collect()} == want
    assert got.count() == len(want)


def test_later_links_meet_the_roots_known_so_far(spark):
    schema = "a long, b long"
    first = components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], schema))
    got = components(spark.createDataFrame([(3, 11), (30, 31), (2, 1)], schema), first)
    want = {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 30, 31: 30}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert components(spark.createDataFrame([], schema), first).count() == 7


def test_many_rows_without_id_or_with_one_id(spark):
    rng = random.Random(5)
    text = lambda: [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30)]
    bases = [text() for _ in range(40)]
    rows = [(None if k % 2 else 7, " ".join([*b, *["x"] * (k % 3)])) for b in bases for k in range(6)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n long")
    got = jaccard.join(df, keep=["n"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.n)
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(range(6 * b, 6 * b + 6)) for b in range(40)
    }
    assert all(r.component_id == 7 for r in got)
