import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from personae.llm import source_audit
from personae.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, term string, gid int"


def brute(rows, least=10, top=10):
    """The contract in plain Python."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(
            r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper)
        )
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        own = {g[1]: c for g, c in counts.items() if g[0] == lang}

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t) for t in own if t != s]
            words = [(-f(p[s][w], q[w]), w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", words)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                found = found[:top] if part == "term" else found
                out += [(lang, s, part, i, -v, r + 1) for r, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    words = ["Alpha", "beta", "gamma-delta", "ÉTÉ", "été", "naïve", "x1y", "I'm", "的文", "Z_z"]
    words += [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(5)]
    out = []
    for i in range(300):
        lang = ["en", "de", None, ""][int(rng.integers(0, 4))]
        source = "hot" if i % 3 == 0 else [None, "", "a", "b c", "ß"][int(rng.integers(0, 5))]
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)) ** (1 + i % 2)))
        out.append((i, text, lang, source))
    out += [(1, None, "en", "only null"), (1, "", "fr", "empty"), (1, "?!", "fr", "signs")]
    out += [(None, "Alpha " * 40_000, "en", "hot"), (7, "beta\x00beta\ngamma", "en", "hot")] * 2
    return out


@pytest.mark.parametrize("memory", [100, source_audit.MEMORY])
def test_equals_plain_counts(spark, rows, memory, monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 16 if memory == 100 else source_audit.PIECE)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = source_audit.audit(df, memory=memory).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_empty_table_and_lonely_group(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert source_audit.audit(df.limit(0)).count() == 0
    assert source_audit.audit(df.where("source = 'only null'")).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(source_audit, "SLICE", 7)
    data = "one TWO threeééééé four5five".encode()
    assert sum(source_audit.terms(data), []) == [
        w.encode() for w in ("one", "two", "threeééééé", "four", "five")
    ]


def test_shares_are_exact(spark):
    cases = [(2, 3), (9 * 10**14, 10**15 - 1), (1, 7), (5, 5), (123456789, 987654321987)]
    cases += [(0, 0), (10**15, 9 * 10**15)]
    df = spark.createDataFrame(cases, "c long, n long")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(source_audit.share(F.col("c"), F.col("n"))).collect()]
    assert got == [1 + (10**9 * c // n if n else 0) for c, n in cases]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{Path(SF, 'documents.parquet')}'")
    want = con.execute(SQL["op13_source_audit"]).fetchall()
    got = QUERIES["op13_source_audit"](spark, SF).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
