import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest

from personae.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in rows:
        ids = tool.encode(text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        out.append((i, start, len(ids), crc))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def rows():
    text = ["The thing", None, "", "it's <|endoftext|> word " * 40, "long " * 30_000, "É 😀"]
    return [(i * 3, text[i % len(text)]) for i in range(60)]


@pytest.fixture(scope="module")
def files(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tokens") / "orc")
    df = spark.createDataFrame([(*r, 1) for r in rows[::-1]], "doc_id long, text string, offset int")
    tf.write(df.repartition(3), PATH, out, files=4)
    return out


def test_round_trip(spark, rows, files):
    got = tf.digests(spark, files).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_files_are_in_order(spark, rows, files):
    seen = []
    for name in sorted(glob.glob(f"{files}/part-*")):
        table = orc.read_table(name)
        assert table["offset"].to_pylist() == [0, *np.cumsum(table["n_tokens"].to_numpy())][:-1]
        seen += table["doc_id"].to_pylist()
    assert seen == [i for i, _ in rows] and len(glob.glob(f"{files}/part-*")) > 1


def test_indexes_and_bloom_filters(spark, files):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    name = sorted(glob.glob(f"{files}/part-*"))[0]
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(
        jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf)
    )
    assert reader.getRowIndexStride() == tf.ROWS_PER_INDEX
    stripe = reader.getStripes().get(0)
    footer = reader.rows().readStripeFooter(stripe)
    kinds = {str(s.getKind()) for s in footer.getStreamsList()}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_lookup(spark, rows, files):
    got = tf.lookup(spark, files, [9, 10]).collect()
    assert [(r.doc_id, r.ids[-1]) for r in got] == [(9, 1)]
    plan = tf.lookup(spark, files, [9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_odd_ids(spark):
    rows = [(None, "b"), (5, "x"), (5, "x"), (5, "y z"), (-2, "minus")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tf.round_trip(df, PATH, files=3).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -2, 5, 5, 5]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])][:-1]
    again = tf.round_trip(df.repartition(2), PATH, files=2).orderBy("start").collect()
    assert got == again


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tf.round_trip(df, PATH, files=2).count() == 0
