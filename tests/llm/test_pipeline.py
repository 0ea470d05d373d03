import random
import re

import public_tokenizers
import pytest

import corpus_pipeline as P
from personae.llm import langid, quality, secret_scan
from personae.llm.batches import remainder, table
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_packing import check
from tests.llm.test_secrets import brute as spans

SF = "/root/testdata/sf0.001"


def plain(docs, language, good):
    """What the first four stages keep, document by document."""
    kept = []
    for d in docs:
        lang, _, fit = language.score([d.text])
        if lang[0] != "und" and fit[0] >= -P.FAR and good.score([d.text])[0] >= 0.3:
            kept.append(d)
    smallest = {r[2] for r in groups([(d.doc_id, d.text) for d in kept])}
    out = {}
    for d in kept:
        if d.doc_id in smallest:
            text, at, end = "", 0, -1
            for a, _, b in spans(d.text):
                if a >= end:
                    text += d.text[at:a] + secret_scan.MASK
                at = end = max(end, b)
            out[d.doc_id] = text + d.text[at:]
    return out


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    language = langid.train(docs, where=remainder("doc_id", 4) != 2)
    good = quality.train(docs, table(spark, SF, "labels"), where=remainder("doc_id", 5) != 0)
    want = plain(docs.collect(), language, good)
    assert 100 < len(want) < docs.count()
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(tool.encode(t, add_special_tokens=False).ids) for i, t in want.items()}
    check(P.run(spark, SF).collect(), lengths, (512, 1024, 2048, 4096, 8192))


@pytest.fixture(scope="module")
def odd(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (None, None, "en", "s", None, 1), (1, "", None, "s", 0, 1), (2, "12 34", "en", None, 5, 1),
        (3, text, "en", "s", 48, 1), (3, text, "en", "s", 48, 1), (4, text, "en", "s", 48, 1),
        (None, "other words without any id at all", "en", "s", 9, 1),
        (None, "words of another text, with no id", "en", "s", 9, 1),
        (9, "token = abcdef123456, the rest stays", "en", "s", 36, 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int"
    return spark.createDataFrame(rows, schema)


def test_one_row_of_each_group_stays(spark, odd):
    rows = P.near_duplicates(spark, odd, SF).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "9", "None", "None", "None"]
    assert rows[0].__fields__ == P.COLUMNS


def test_rows_stay_themselves_if_splits_change(spark, tmp_path):
    rows = [(i, f"text {i // 2} of its own words a{i // 2} b{i // 2} c{i // 2}", "en", "s", 9)
            for i in range(400)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, schema).repartitionByRange(12, "doc_id").write.parquet(path)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "1k")
        kept = P.near_duplicates(spark, spark.read.parquet(path), SF)
        spark.conf.set(size, "128m")
        got = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.set(size, before)
    assert got == list(range(0, 400, 2))


def test_letterless_texts_go(spark, odd):
    rows = P.language(spark, odd, SF).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "4", "9", "None", "None"]


def test_language_rejects_letters_that_are_no_language(spark):
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(n))
            for n in (30, 100, 500)]
    junk += ["Это русский текст о погоде и природе", "的一是在不了有和人这中大为上个国" * 3,
             "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=400))]
    docs = table(spark, SF, "documents").select(*P.COLUMNS)
    odd = [(10**6 + i, text, "en", "s", len(text)) for i, text in enumerate(junk)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {r.doc_id for r in P.language(spark, both, SF).collect()}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert max(kept) < 10**6 and kept == lettered  # clean, short and repetitive ones all stay


def test_secrets_are_masked(spark, odd):
    rows = {r.doc_id: r for r in P.secrets(spark, odd, SF).where("doc_id is not null").collect()}
    assert rows[9].text == "[SECRET], the rest stays" and rows[9].n_chars == 24
    assert rows[2].text == "12 34" and rows[1].n_chars == 0
    assert len(P.secrets(spark, odd, SF).collect()) == odd.count()


def test_stages_take_empty_tables(spark, odd):
    docs = odd.limit(0)
    for name, stage in P.STAGES:
        assert re.fullmatch("[a-z_]+", name) and stage(spark, docs, SF).count() == 0
