import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from personae.operators.scale import (
    dense_index,
    fits_broadcast,
    hot_keys,
    last_before,
    materialize,
    scratch_dir,
    scratch_scope,
    skew_join,
)


def test_scratch_dir_is_the_clusters(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_dir_without_a_setting_is_in_the_warehouse():
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://host/warehouse/"}.get(key, default)

    class Session:
        conf = Conf()

    assert scratch_dir(Session()) == "hdfs://host/warehouse/_scratch"


def test_materialize_and_size_check(spark):
    df = spark.range(10)
    assert materialize(df, "t").count() == 10
    assert fits_broadcast(df, 10) and not fits_broadcast(df, 9)


def test_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 100 + [("b",)] * 3 + [(None,)] * 500, "k string")
    (key, salts), = hot_keys(df, ["k"], 10)
    assert salts == 10
    assert key == df.where("k = 'a'").select(F.xxhash64("k")).first()[0]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_skew_join_equals_join(spark, how, hot_rows):
    rng = random.Random(3)
    facts = [(i, rng.choice(["hot"] * 6 + [None, None, "x", "y", "z"]), rng.choice([1, 2]))
             for i in range(500)]
    fact = spark.createDataFrame(facts, "id int, k string, n int")
    dim = spark.createDataFrame([("hot", 1, "h1"), ("hot", 2, "h2"), ("x", 1, "x1"), ("q", 1, "q")],
                                "k string, n int, v string")
    plain = fact.join(dim, ["k", "n"], how).select("id", "k", "n", "v").collect()
    salted = skew_join(fact, dim, ["k", "n"], "id", how, hot_rows)
    assert sorted(salted.columns) == ["id", "k", "n", "v"]
    assert sorted(map(str, salted.select("id", "k", "n", "v").collect())) == sorted(map(str, plain))


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_rows_without_a_key_do_not_meet_in_one_task(spark, how):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(1000).select("id", F.when(F.col("id") < 10, F.col("id")).alias("k"))
        dim = spark.range(10).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        joined = skew_join(fact, dim, ["k"], "id", how)
        at = joined.where("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in at) == 990
        assert max(r["count"] for r in at) < 500
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_skew_join_of_different_types(spark):
    fact = spark.createDataFrame([(i, 1 if i < 180 else i) for i in range(200)], "id int, k int")
    dim = spark.createDataFrame([(k, "v") for k in [*range(200), 2**40 + 1]], "k bigint, v string")
    joined = skew_join(fact, dim, ["k"], "id", "inner", 20)
    assert joined.count() == 200
    with pytest.raises(TypeError):
        skew_join(fact, dim.withColumn("k", F.col("k").cast("string")), ["k"], "id")


def test_broadcasts_are_measured_in_bytes(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("s"))
    assert fits_broadcast(df, 10, 1000) and not fits_broadcast(df, 10, 999)


def test_skew_join_spreads_the_hot_key(spark):
    fact = spark.range(4000).select("id", F.lit("hot").alias("k"))
    dim = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_join(fact, dim, ["k"], "id", "inner", 100)
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in per_task) == 4000
    assert max(r["count"] for r in per_task) < 2000


def test_dense_index(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaab"), i) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, o int").repartition(7)
    got = {(r.g, r.o): r.n for r in dense_index(df, ["g"], ["o"], "n").collect()}
    expected = {}
    for g in "ab":
        for n, o in enumerate(sorted(o for x, o in rows if x == g)):
            expected[(g, o)] = n
    assert got == expected


def test_scratch_scope_drops_its_tables(spark):
    before = materialize(spark.range(3), "kept")
    with scratch_scope(spark):
        inner = materialize(spark.range(5), "dropped")
        assert inner.count() == 5
        path = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert not Path(path).exists() and before.count() == 3


@pytest.mark.parametrize("span", [3, 1000])
def test_last_before(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "a", "b", "c"]), n * 7, rng.choice([None, None, n])) for n in range(80)]
    rng.shuffle(rows)
    got = last_before(spark.createDataFrame(rows, "g string, seq bigint, v bigint"), ["g"], "seq", "v",
                      "p", span).collect()
    assert len(got) == 80
    for r in got:
        earlier = sorted((s, v) for g, s, v in rows if g == r.g and s < r.seq and v is not None)
        assert r.p == (earlier[-1][1] if earlier else None)
    none = spark.createDataFrame([], "g string, seq bigint, v bigint")
    assert last_before(none, ["g"], "seq", "v", "p").count() == 0
