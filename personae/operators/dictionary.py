"""First-name dictionary: membership and longest known prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import MIN_PREFIX, MIN_REMAINDER
from personae.functions.text import utf16_length
from personae.operators.scale import (
    BROADCAST_ROWS,
    HOT_ROWS,
    fits_broadcast,
    materialize,
    skew_join,
)


class NameDictionary:
    """Known first names, given as a DataFrame with a ``name`` column.

    Up to ``broadcast_rows`` names (counted) the lookups are broadcast joins and
    add no shuffle; a larger dictionary is joined by salted shuffles.
    """

    def __init__(self, names: DataFrame, broadcast_rows: int = BROADCAST_ROWS,
                 hot_rows: int = HOT_ROWS) -> None:
        lowered = names.select(F.lower("name").alias("name")).where("name <> ''").distinct()
        # stored, because every lookup reads it
        self.names = materialize(lowered, "names")
        self.hot_rows = hot_rows
        self.small = fits_broadcast(self.names, broadcast_rows)
        self.buckets = materialize(self._prefix_buckets(), "prefixes") if self.small else None

    def _prefix_buckets(self) -> DataFrame:
        """Names that share their first letters as one small array per prefix.

        The arrays together hold no more than the checked number of names.
        """
        return (
            self.names.where(utf16_length(F.col("name")) >= MIN_PREFIX)
            .groupBy(F.left("name", F.lit(MIN_PREFIX)).alias("_head"))
            .agg(F.collect_list("name").alias("_names"))
        )

    def flag(self, df: DataFrame, tokens: dict[str, str | Column], row_id: str) -> DataFrame:
        """Add a boolean column per entry of {new column: token column}."""
        for out, token in tokens.items():
            token = F.col(token) if isinstance(token, str) else token
            known = self.names.select(F.col("name").alias("_token"), F.lit(True).alias(out))
            keyed = df.withColumn("_token", F.lower(token))
            if self.small:
                joined = keyed.join(F.broadcast(known), "_token", "left")
            else:
                joined = skew_join(keyed, known, ["_token"], row_id, "left", self.hot_rows)
            df = joined.withColumn(out, F.coalesce(F.col(out), F.lit(False))).drop("_token")
        return df

    def longest_prefix(self, df: DataFrame, token: str, out: str, row_id: str) -> DataFrame:
        """Add the length of the longest known name a run-on token starts with.

        The name needs MIN_PREFIX characters and MIN_REMAINDER must follow it.
        """
        return (
            self._prefix_by_bucket(df, token, out)
            if self.small
            else self._prefix_by_join(df, token, out, row_id)
        )

    def _prefix_by_bucket(self, df: DataFrame, token: str, out: str) -> DataFrame:
        lowered = F.lower(token)
        joined = df.withColumn("_head", F.left(lowered, F.lit(MIN_PREFIX))).join(
            F.broadcast(self.buckets), "_head", "left"
        )
        room = utf16_length(F.col(token)) - MIN_REMAINDER
        fitting = F.filter(
            "_names", lambda n: F.startswith(lowered, n) & (utf16_length(n) <= room)
        )
        longest = F.array_max(F.transform(fitting, F.length))
        return joined.withColumn(out, longest).drop("_head", "_names")

    def _prefix_by_join(self, df: DataFrame, token: str, out: str, row_id: str) -> DataFrame:
        room = F.length(token) - 1
        prefixes = (
            df.where(room >= MIN_PREFIX)
            .select(row_id, token, F.explode(F.sequence(F.lit(MIN_PREFIX), room)).alias("_n"))
            .withColumn("_token", F.left(F.lower(token), F.col("_n")))
            .where(
                utf16_length(F.col(token)) - utf16_length(F.col("_token")) >= MIN_REMAINDER
            )
            .select(row_id, "_n", "_token")
        )
        known = self.names.select(F.col("name").alias("_token"))
        hits = skew_join(prefixes, known, ["_token"], row_id, "inner", self.hot_rows)
        best = hits.groupBy(row_id).agg(F.max("_n").cast("int").alias(out))
        return df.join(best, row_id, "left")
