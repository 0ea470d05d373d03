"""Incremental enrichment: every micro-batch of new rows is one snapshot run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from personae.config import DEFAULT_DESCRIPTORS, DEFAULT_WEIGHTS, Descriptors, Weights
from personae.operators.cache import KEY
from personae.operators.dictionary import NameDictionary
from personae.operators.scale import scratch_scope
from personae.plans.enrich import enrich
from personae.schema import (
    CREATORS,
    IDENTITY_CACHE,
    IDENTITY_CACHE_KEYS,
    PROCESSING_LOGS,
    PROFILE_SNAPSHOTS,
    empty,
)
from personae.streaming.store import KeyedStore

APPENDED: dict[str, T.StructType] = {
    "creators": CREATORS,
    "processing_logs": PROCESSING_LOGS,
    "profile_snapshots": PROFILE_SNAPSHOTS,
}
KEYED: dict[str, tuple[T.StructType, list[str]]] = {
    "identity_cache": (IDENTITY_CACHE, ["id"]),
    "identity_cache_keys": (IDENTITY_CACHE_KEYS, KEY),
}


@dataclass
class IncrementalEnrichment:
    """State folder plus the inputs that do not change between batches.

    Records, logs and snapshots are folders with one sub-folder per batch. The identity cache
    and its keys are keyed stores: a batch reads the buckets that its keys fall into, as
    earlier batches left them, and commits its own rows. Replaying the last batch after a
    failure gives the same rows and never sees the keys it wrote before. Scratch tables of a
    batch go as soon as it is committed.
    """

    spark: SparkSession
    state_dir: str
    dictionary: NameDictionary
    pages: DataFrame | None = None
    weights: Weights = DEFAULT_WEIGHTS
    descriptors: Descriptors = DEFAULT_DESCRIPTORS
    buckets: int = 64

    def store(self, name: str, before: int | None = None) -> KeyedStore:
        schema, keys = KEYED[name]
        return KeyedStore(
            self.spark, f"{self.state_dir}/{name}", schema, keys, before, self.buckets
        )

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """Stored rows of a table, optionally only those of batches < ``before``.

        Of the identity cache and its keys, only the last two states are kept.
        """
        if name in KEYED:
            return self.store(name, before).rows()
        schema = T.StructType([*APPENDED[name].fields, T.StructField("batch_id", T.LongType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.state_dir}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty(self.spark, schema)  # before the first batch
        return rows if before is None else rows.where(F.col("batch_id") < before)

    def run_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Enrich one batch of creators rows and store its outputs."""
        stores = {name: self.store(name, batch_id) for name in KEYED}
        with scratch_scope(self.spark):
            result = enrich(
                rows, self.dictionary, stores["identity_cache"], stores["identity_cache_keys"],
                self.pages, mode="snapshot", weights=self.weights,
                descriptors=self.descriptors, run_id=f"batch-{batch_id}",
                now=F.current_timestamp(),
            )
            outputs = {
                "creators": result.creators,
                "processing_logs": result.logs,
                "profile_snapshots": result.snapshots,
            }
            for name, df in outputs.items():
                df.write.mode("overwrite").parquet(
                    f"{self.state_dir}/{name}/batch_id={batch_id}"
                )
            # keys last: who finds a key finds its identity
            stores["identity_cache"].commit(result.new_identities, batch_id)
            stores["identity_cache_keys"].commit(result.new_keys, batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Attach to a streaming DataFrame of creators rows."""
        writer = stream.writeStream.foreachBatch(
            self.run_batch
        ).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
