"""Identity cache: lookup by key, conflict detection, additive writes.

Key owners never change: the first writer of a (key_type, key_value) owns it, and
stored identities are never overwritten by fresh evidence.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personae.functions.keys import (
    canonical_email,
    canonical_profile_url,
    canonical_username,
    key_array,
)
from personae.functions.text import blank_to_null
from personae.operators.scale import HOT_ROWS, materialize, skew_join
from personae.schema import IDENTITY_CACHE, IDENTITY_CACHE_KEYS, conform

KEY = ["key_type", "key_value"]


class Stored(Protocol):
    """A table that reads only what may match some keys (see ``streaming.store``)."""

    def touching(self, keys: DataFrame) -> DataFrame: ...


def matching(table: DataFrame | Stored, keys: DataFrame) -> DataFrame:
    """The rows of a cache table that may match ``keys``; all rows of a plain table."""
    return table if isinstance(table, DataFrame) else table.touching(keys)


def record_keys(
    df: DataFrame, email: Column, username: Column, profile_url: Column, *carry: str
) -> DataFrame:
    """One row per identity key of a record: ``carry`` columns, key_pos and the key."""
    canonical = df.select(
        *carry,
        canonical_email(email).alias("_email"),
        canonical_username(username).alias("_username"),
        canonical_profile_url(profile_url).alias("_url"),
    )
    keys = key_array(F.col("_email"), F.col("_username"), F.col("_url"))
    return canonical.select(*carry, F.posexplode(keys).alias("key_pos", "_key")).select(
        *carry, "key_pos", "_key.key_type", "_key.key_value"
    )


def lookup_keys(df: DataFrame, *carry: str) -> DataFrame:
    return record_keys(df, F.col("n_email"), F.col("n_username"), F.col("n_profile_url"), *carry)


def write_keys(df: DataFrame, *carry: str) -> DataFrame:
    """Keys of the resolved identity (which falls back to the normalized input)."""
    return record_keys(
        df, F.col("resolved_email"), F.col("resolved_social_handle"),
        F.col("resolved_profile_url"), *carry,
    )


def identity_id(record_id: Column) -> Column:
    """Deterministic id of the identity a record creates."""
    return F.sha2(F.concat_ws("|", F.lit("identity"), record_id), 256)


def distinct_in_key_order(pos: Column, identity: Column) -> Column:
    """Aggregate: a record's distinct identities, in the order of its (at most 3) keys."""
    hits = F.collect_list(
        F.when(identity.isNotNull(), F.struct(pos.alias("pos"), identity.alias("identity")))
    )
    return F.array_distinct(F.transform(F.sort_array(hits), lambda h: h["identity"]))


def match_status(ids: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "miss")
        .when(F.size(ids) == 1, "hit")
        .otherwise("conflict")
    )


def lookup(
    records: DataFrame, cache_keys: DataFrame | Stored, row_id: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add cache_status (miss / hit / conflict) and matched_ids to normalized records.

    ``records`` are scanned several times: pass narrow stored rows.
    """
    keys = lookup_keys(records, row_id)
    stored = matching(cache_keys, keys.select(*KEY)).select(*KEY, "identity_cache_id")
    found = skew_join(keys, stored, KEY, row_id, "inner", hot_rows)
    matches = found.groupBy(row_id).agg(
        distinct_in_key_order(F.col("key_pos"), F.col("identity_cache_id")).alias("matched_ids")
    )
    return records.join(matches, row_id, "left").withColumn(
        "cache_status", match_status(F.col("matched_ids"))
    )


def attach_identities(
    records: DataFrame, identity_cache: DataFrame | Stored, on: str, row_id: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join the cached fields as c_* columns."""
    identity_cache = matching(identity_cache, records.select(F.col(on).alias("id")))
    fields = [
        "first_name", "last_name", "display_name", "platform", "profile_url", "email",
        "social_handle", "confidence_score", "confidence_source",
    ]
    dim = identity_cache.select(
        F.col("id").alias(on), *[F.col(f).alias(f"c_{f}") for f in fields]
    )
    return skew_join(records, dim, [on], row_id, "left", hot_rows)


@dataclass
class CacheWrites:
    decisions: DataFrame  # id, write_action (create / add), write_identity_id
    new_keys: DataFrame   # key_type, key_value, identity_cache_id


def plan_writes(
    writers: DataFrame, cache_keys: DataFrame | Stored, order: list[str], row_id: str = "id",
    hot_rows: int = HOT_ROWS,
) -> CacheWrites:
    """Decide what a batch of writers adds to the cache as of batch start.

    No stored match: the record creates an identity if it comes first on every one
    of its keys, else its write is skipped. One match: the record adds its keys to
    that identity, first writer of a key wins. Several matches: skipped.
    """
    keys = write_keys(writers, row_id, *order)
    stored = matching(cache_keys, keys.select(*KEY)).select(*KEY, "identity_cache_id")
    seen = skew_join(keys, stored, KEY, row_id, "left", hot_rows)
    per_record = Window.partitionBy(row_id)  # at most three keys
    seen = seen.withColumns(
        {
            "_owners": F.collect_set("identity_cache_id").over(per_record),
            "_n_keys": F.count("*").over(per_record),
        }
    )
    seen = materialize(seen.drop("key_pos"), "write-keys")
    free = seen.where(F.col("identity_cache_id").isNull() & (F.size("_owners") <= 1))
    first = free.groupBy(*KEY).agg(
        F.min(F.struct(*order, row_id, "_owners", "_n_keys")).alias("_f")
    )
    first = first.select(
        *KEY, F.col(f"_f.{row_id}").alias(row_id), "_f._owners", "_f._n_keys"
    )
    first = first.withColumn(
        "_won", F.count("*").over(Window.partitionBy(row_id))
    ).withColumn(
        "write_identity_id",
        F.when(F.size("_owners") == 1, F.get("_owners", F.lit(0)))
        .when(F.col("_won") == F.col("_n_keys"), identity_id(F.col(row_id))),
    )
    first = materialize(first.where("write_identity_id IS NOT NULL"), "claimed-keys")
    new_keys = first.select(*KEY, F.col("write_identity_id").alias("identity_cache_id"))
    creates = (
        first.where(F.size("_owners") == 0)
        .select(row_id, F.lit("create").alias("write_action"), "write_identity_id")
        .distinct()
    )
    adds = (
        seen.where(F.size("_owners") == 1)
        .select(row_id, F.lit("add").alias("write_action"),
                F.get("_owners", F.lit(0)).alias("write_identity_id"))
        .distinct()
    )
    return CacheWrites(creates.unionByName(adds), new_keys)


def new_identities(created: DataFrame, now: Column) -> DataFrame:
    """Identity rows from records with resolved_* and write_identity_id."""
    fields = ["first_name", "last_name", "display_name", "platform", "profile_url", "email",
              "social_handle"]
    return conform(
        created.select(
            F.col("write_identity_id").alias("id"),
            *[F.col(f"resolved_{f}").alias(f) for f in fields],
            "confidence_score", "confidence_source", "pipeline_version",
            F.lit(False).alias("verified"),
            now.alias("created_at"),
            now.alias("updated_at"),
        ),
        IDENTITY_CACHE,
    )


def add_keys(cache_keys: DataFrame, additions: DataFrame, order: list[str]) -> DataFrame:
    """Insert-or-ignore: stored keys stay, of the additions the first per key is kept."""
    first = additions.groupBy(*KEY).agg(
        F.min(F.struct(*order, "identity_cache_id", "created_at")).alias("_f")
    ).select(*KEY, "_f.identity_cache_id", "_f.created_at")
    fresh = first.join(cache_keys.select(*KEY), KEY, "left_anti")
    return conform(cache_keys, IDENTITY_CACHE_KEYS).unionByName(
        conform(fresh, IDENTITY_CACHE_KEYS)
    )


def create_identities(
    cache: DataFrame, cache_keys: DataFrame, records: DataFrame, order: list[str],
    now: Column,
) -> tuple[DataFrame, DataFrame]:
    """Create one identity per record, even when all its keys belong to others.

    ``records`` has write_identity_id, resolved_*, confidence_*, pipeline_version
    and the key source columns key_email, key_username and key_profile_url.
    """
    keys = record_keys(
        records, F.col("key_email"), F.col("key_username"), F.col("key_profile_url"),
        "write_identity_id", *order,
    ).withColumnsRenamed({"write_identity_id": "identity_cache_id"}).withColumn(
        "created_at", now
    )
    return (
        conform(cache, IDENTITY_CACHE).unionByName(new_identities(records, now)),
        add_keys(cache_keys, keys, order),
    )


def resolved_or_raw(field: str, raw: str) -> Column:
    """Key source of a reviewed record: NULL falls through, then '' is absent."""
    return blank_to_null(F.coalesce(F.col(field), F.col(raw)))
