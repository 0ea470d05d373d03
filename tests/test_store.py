from pyspark.sql import types as T

from personae.streaming.store import FAN, KeyedStore

SCHEMA = T.StructType(
    [T.StructField("k", T.StringType()), T.StructField("v", T.LongType())]
)


def store(spark, path, before=None):
    return KeyedStore(spark, str(path), SCHEMA, ["k"], before, buckets=8)


def batch(spark, n, rows=20):
    return spark.createDataFrame([(f"{n}-{i}", n) for i in range(rows)], SCHEMA)


def files(path):
    return len([f for f in (path / "rows").rglob("*.parquet")])


def test_runs_merge_and_files_do_not_grow_with_batches(spark, tmp_path):
    seen = []
    for n in range(FAN * FAN + 2):
        s = store(spark, tmp_path, n)
        assert s.rows().count() == 20 * n
        s.commit(batch(spark, n), n)
        levels = [level for _, level in store(spark, tmp_path).runs()]
        assert all(levels.count(level) < FAN for level in levels)
        seen.append(files(tmp_path))
        assert len(list((tmp_path / "manifest").iterdir())) <= 2 + 2  # and their checksums
    assert [level for _, level in store(spark, tmp_path).runs()] == [0, 0, 2]
    # two states are kept, of at most FAN - 1 runs a level in 8 buckets
    assert max(seen) <= 2 * 8 * 3 * FAN
    rows = store(spark, tmp_path).rows().collect()
    assert len({r.k for r in rows}) == len(rows) == 20 * (FAN * FAN + 2)


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    for n in range(5):
        store(spark, tmp_path, n).commit(batch(spark, n), n)
    s = store(spark, tmp_path, 5)
    keys = spark.createDataFrame([("3-7",), ("3-7",), ("none",), (None,)], "k string")
    got = s.touching(keys)
    assert [tuple(r) for r in got.collect()] == [("3-7", 3)]
    buckets = {r.b for r in keys.dropna().select(s._bucket().alias("b")).collect()}
    read = s._read([r for r, _ in s.runs()]).where(f"bucket in ({', '.join(map(str, buckets))})")
    assert len(read.inputFiles()) <= len(s.runs()) * 8
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_replay_sees_and_gives_the_same(spark, tmp_path):
    for n in range(FAN):
        store(spark, tmp_path, n).commit(batch(spark, n), n)
    last = FAN - 1  # its commit merged the runs
    assert [r for r, _ in store(spark, tmp_path).runs()] == [f"m{last}"]
    s = store(spark, tmp_path, last)
    assert s.rows().count() == 20 * last
    s.commit(batch(spark, last, 25), last)
    assert store(spark, tmp_path).rows().count() == 20 * last + 25
    assert [r for r, _ in store(spark, tmp_path).runs()] == [f"m{last}"]
    store(spark, tmp_path, FAN).commit(batch(spark, FAN, 0), FAN)
    assert store(spark, tmp_path).rows().count() == 20 * last + 25


def test_before_the_first_batch(spark, tmp_path):
    s = store(spark, tmp_path / "none", 0)
    assert s.runs() == [] and s.rows().count() == 0
    assert s.touching(spark.createDataFrame([("a",)], "k string")).count() == 0
