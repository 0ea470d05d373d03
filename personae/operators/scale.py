"""Building blocks that keep plans healthy on large and skewed tables.

* ``materialize``  - cut lineage with a table in the cluster's shared folder
* ``scratch_scope`` - drop those tables once their results are stored
* ``fits_broadcast`` - the size check in front of a broadcast
* ``skew_join``    - equi-join whose hot keys are measured and salted
* ``dense_index``  - 0..n-1 numbering per group without a one-task window
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from personae.schema import literal_table

# A dimension is broadcast only after measuring that it has no more rows and bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# A join key with more rows than this is split over ceil(n / HOT_ROWS) salts.
HOT_ROWS = 1_000_000
# Counters of the sketch that measures keys, and the share 1/CERTAIN it never misses.
SKETCH = 2_000
CERTAIN = 500


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that ``materialize`` writes inside, once the block has ended well.

    What is to outlive the block must be written elsewhere.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
    for path in paths:
        drop_folder(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives lost executors, ends the lineage, and as parquet later
    readers still prune its columns.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/personae/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(
    df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """At most ``rows`` rows, whose text has at most ``size`` bytes."""
    text = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns]))
    n, total = df.select(text.alias("n")).limit(rows + 1).agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    return n <= rows and total <= size


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> list[tuple[int, int]]:
    """(key hash, salts) of the keys with more than ``hot_rows`` rows.

    A frequent-items sketch per task, merged: no shuffle of the keys. It is certain to
    find keys above 1/CERTAIN of all rows; a table so large that hot keys may be smaller
    is counted exactly, which gives at most rows / hot_rows results.
    """
    keyed = df.where(_all_present(keys)).select(F.xxhash64(*keys).alias("_hash"))
    sketch = F.call_function(
        "approx_top_k", F.col("_hash"), F.lit(SKETCH // 2), F.lit(SKETCH)
    )
    found = keyed.agg(sketch.alias("top"), F.count("*").alias("n")).first()
    counts = [(i["item"], i["count"]) for i in found["top"] or []]
    if found["n"] > CERTAIN * hot_rows:
        exact = keyed.groupBy("_hash").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
        counts = [(r["_hash"], r["n"]) for r in exact.collect()]
    return [(key, -(-n // hot_rows)) for key, n in counts if n > hot_rows]


def skew_join(
    fact: DataFrame, dim: DataFrame, on: Sequence[str], row_id: str | Sequence[str],
    how: str = "left", hot_rows: int = HOT_ROWS, hot: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """Equi-join where any share of ``fact`` may sit on one key.

    Rows of hot keys get a salt from their ``row_id`` hash and the matching ``dim``
    row is copied once per salt. Rows with a NULL key match nothing; in a left join or anti join
    they are spread instead of meeting in one task. ``fact`` is scanned once more to
    measure its keys: join narrow or stored tables. ``hot`` are ``hot_keys`` measured before,
    on the same or more rows.
    """
    keys = list(on)
    keeps = how in ("left", "left_anti")  # rows without a match are in the result
    # the hashes below depend on the type; a value that only the wider one holds has no match
    for k in keys:
        mine, other = fact.schema[k].dataType, dim.schema[k].dataType
        if mine != other:
            if not (isinstance(mine, IntegralType) and isinstance(other, IntegralType)):
                raise TypeError(f"key {k} is {mine.simpleString()} and {other.simpleString()}")
            dim = dim.withColumn(k, F.col(k).try_cast(mine))
    hot = hot_keys(fact, keys, hot_rows) if hot is None else hot
    spread = F.xxhash64(*([row_id] if isinstance(row_id, str) else row_id))
    none = F.lit(0).cast("bigint")
    if hot:
        # one row for each hot key
        table = F.broadcast(literal_table(fact.sparkSession, hot, ["_hash", "_salts"]))
        fact = fact.withColumn("_hash", F.xxhash64(*keys)).join(table, "_hash", "left")
        dim = dim.withColumn("_hash", F.xxhash64(*keys)).join(table, "_hash", "left")
        last = (F.coalesce("_salts", F.lit(1)) - 1).cast("bigint")
        dim = dim.withColumn("_salt", F.explode(F.sequence(none, last)))
        salt = F.coalesce(F.pmod(spread, F.col("_salts")), none)
        fact, dim = fact.withColumn("_salt", salt), dim.drop("_hash", "_salts")
    elif keeps:
        # no literal: the optimizer would take it out of the keys, and the NULLs would meet again
        here = F.xxhash64(*keys)
        fact, dim = fact.withColumn("_salt", here), dim.withColumn("_salt", here)
    else:
        return fact.join(dim, keys, how)
    if keeps:
        salt = F.when(_all_present(keys), F.col("_salt")).otherwise(spread)
        fact = fact.withColumn("_salt", salt)
    return fact.join(dim, [*keys, "_salt"], how).drop("_salt", "_hash", "_salts")


def _all_present(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def dense_index(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str,
    label: str = "numbered",
) -> DataFrame:
    """Number rows 0..n-1 per ``group`` in ``order``.

    A window partitioned by ``group`` would sort a whole group in one task. Here
    the rows are range-sorted by (group, order), so a big group spans many
    partitions; positions inside a partition plus the row counts of the earlier
    partitions of the group give the number.
    """
    placed = (
        df.orderBy(*group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return index_placed(materialize(placed, label), group, ["_part"], "_pos", name).drop(
        "_part", "_pos"
    )


def index_placed(
    df: DataFrame, group: Sequence[str], split: Sequence[str], pos: str, name: str
) -> DataFrame:
    """Turn (split, position in split) into a dense number per group.

    ``df`` must be stored, rows of one (group, split) must have consecutive
    positions. Only one row per (group, split) is shuffled.
    """
    sizes = df.groupBy(*group, *split).agg(
        F.count("*").alias("_rows"), F.min(pos).alias("_first")
    )
    before = Window.partitionBy(*group).orderBy(*split).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn(
        "_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    ).drop("_rows", "_first")
    return (
        df.join(offsets, [*group, *split])
        .withColumn(name, (F.col("_offset") + F.col(pos)).cast("bigint"))
        .drop("_offset")
    )


def last_before(
    df: DataFrame, group: Sequence[str], seq: str, value: str, name: str, span: int = HOT_ROWS
) -> DataFrame:
    """Add ``name``: the last ``value`` that is not NULL among the group's rows of smaller ``seq``.

    ``seq`` is a whole number, unique within a group. A group is cut into ranges of ``seq`` with
    about ``span`` rows of the whole table, so that a big group is many tasks' work; one row for
    each range carries the last value over its border.
    """
    n, low, high = df.agg(F.count("*"), F.min(seq), F.max(seq)).first()
    if not n:
        return df.withColumn(name, F.lit(None).cast(df.schema[value].dataType))
    width = max(1, (high - low + 1) * span // n)
    df = df.withColumn("_range", F.call_function("div", F.col(seq) - low, F.lit(width)))
    before = Window.partitionBy(*group, "_range").orderBy(seq).rowsBetween(
        Window.unboundedPreceding, -1
    )
    over = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.where(F.col(value).isNotNull()).groupBy(*group, "_range").agg(
        F.max_by(value, seq).alias("_last")
    )
    # ranges without a value take part, too: they look back
    ranges = df.select(*group, "_range").distinct().join(carried, [*group, "_range"], "left")
    ranges = ranges.select(
        *group, "_range", F.last("_last", ignorenulls=True).over(over).alias("_carried")
    )
    own = df.withColumn("_own", F.last(value, ignorenulls=True).over(before))
    return own.join(ranges, [*group, "_range"]).withColumn(
        name, F.coalesce("_own", "_carried")
    ).drop("_range", "_own", "_carried")
