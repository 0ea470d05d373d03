"""A growing keyed table, of which a batch reads the buckets that its keys fall into.

Rows lie in runs, each a folder with one sub-folder per bucket of the key's hash. A batch adds a run
of level 0. As soon as ``FAN`` runs have one level they become one of the next, with one file per
bucket, so that rows are rewritten once per level and a bucket has fewer than ``FAN`` files of each
level, whatever the number of batches.

A batch commits by writing its manifest, the list of runs; readers take the manifest before their
batch. The manifests of the last two batches and the runs they name are kept, everything older goes:
a batch that is run again finds what it found the first time and replaces what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from personae.operators.scale import drop_folder, fits_broadcast, materialize
from personae.schema import conform, empty

FAN = 4
MANIFEST = "run string, level int"


@dataclass
class KeyedStore:
    """``keys`` identify a row; ``before`` is the batch whose manifest is not yet to be seen."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    before: int | None = None
    buckets: int = 64

    def as_of(self, before: int | None) -> KeyedStore:
        return KeyedStore(self.spark, self.path, self.schema, self.keys, before, self.buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame | None:
        schema = T.StructType.fromDDL(f"{MANIFEST}, version long")
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # before the first batch

    def runs(self) -> list[tuple[str, int]]:
        """(run, level) of the newest manifest before ``before``; a few for each level."""
        found = self._manifests()
        if found is None:
            return []
        if self.before is not None:
            found = found.where(F.col("version") < self.before)
        newest = found.agg(F.max("version")).first()[0]
        rows = [] if newest is None else found.where(F.col("version") == newest).collect()
        return sorted((r.run, r.level) for r in rows if r.run)

    def _read(self, runs: list[str]) -> DataFrame:
        schema = T.StructType(
            [*self.schema.fields, T.StructField("run", T.StringType()),
             T.StructField("bucket", T.IntegerType())]
        )
        if not runs:
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(
            *[self._folder(r) for r in runs]
        )

    def _folder(self, run: str) -> str:
        return f"{self.path}/rows/run={run}"

    def rows(self) -> DataFrame:
        return conform(self._read([run for run, _ in self.runs()]), self.schema)

    def touching(self, keys: DataFrame) -> DataFrame:
        """Stored rows with one of the given keys.

        Only buckets with such a key are read. The keys are sent to the rows where they fit a
        broadcast, as those of a batch do; otherwise both sides are shuffled.
        """
        runs = [run for run, _ in self.runs()]
        if not runs:
            return empty(self.spark, self.schema)
        wanted = materialize(
            keys.select(*self.keys).dropna().distinct().withColumn("bucket", self._bucket()),
            "touched-keys",
        )
        buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]
        rows = self._read(runs).where(F.col("bucket").isin(buckets))
        side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
        found = rows.join(side, [*self.keys, "bucket"], "left_semi")
        return materialize(conform(found, self.schema), "stored-rows")

    def commit(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch, merge runs, publish the manifest, drop what is out of use."""
        known = self.as_of(batch_id).runs()
        target = f"b{batch_id}"
        self._write(conform(rows, self.schema), target)
        runs, merging, level = [*known, (target, 0)], [], 0
        while sum(at == level for _, at in runs) >= FAN:
            merging += [run for run, at in runs if at == level]
            runs = [r for r in runs if r[1] != level]
            level += 1
            runs.append((f"m{batch_id}", level))
        if merging:
            merging = [m for m in merging if m != f"m{batch_id}"]
            self._write(conform(self._read(merging), self.schema), f"m{batch_id}")
        manifest = self.spark.createDataFrame(runs, MANIFEST).coalesce(1)  # a few rows
        manifest.write.mode("overwrite").json(f"{self.path}/manifest/version={batch_id}")
        self._drop_unused(batch_id, {*known, *runs}, target if merging else None)

    def _write(self, rows: DataFrame, run: str) -> None:
        placed = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        placed.sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(self._folder(run))

    def _drop_unused(self, batch_id: int, kept: set[tuple[str, int]], merged: str | None) -> None:
        names = {run for run, _ in kept}
        if merged:
            drop_folder(self.spark, self._folder(merged))
        old = self._manifests().where(F.col("version") < batch_id)
        versions = sorted(r.version for r in old.select("version").distinct().collect())[:-1]
        gone = {
            r.run for r in old.where(F.col("version").isin(versions)).collect()
            if r.run not in names
        }
        for run in sorted(gone):
            drop_folder(self.spark, self._folder(run))
        for version in versions:
            drop_folder(self.spark, f"{self.path}/manifest/version={version}")

