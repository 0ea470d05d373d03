"""Exact-key duplicate candidates within an import.

A group can be as large as the import, so groups are never collected into one
row: ``duplicate_groups`` has one summary row per group and ``duplicate_members``
one row per member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personae.operators.cache import KEY, record_keys, resolved_or_raw
from personae.operators.scale import HOT_ROWS, materialize, skew_join

SCOPE = ["import_id", *KEY]


def _member_keys(creators: DataFrame) -> DataFrame:
    live = creators.where("duplicate_of_creator_id IS NULL")
    return record_keys(
        live,
        resolved_or_raw("resolved_email", "raw_email"),
        resolved_or_raw("resolved_social_handle", "raw_username"),
        resolved_or_raw("resolved_profile_url", "raw_profile_url"),
        "import_id", "row_index", "id", "resolved_first_name", "resolved_last_name",
    ).drop("key_pos")


def _groups(keys: DataFrame) -> DataFrame:
    return (
        keys.groupBy(*SCOPE)
        .agg(F.count("*").alias("size"), F.min(F.struct("row_index", "id")).alias("_first"))
        .where("size > 1")
        .select(*SCOPE, "size", F.col("_first.id").alias("first_creator_id"))
    )


def duplicate_groups(creators: DataFrame) -> DataFrame:
    """import_id, key, size and the member a merge would keep (lowest row_index)."""
    return _groups(_member_keys(creators))


def duplicate_members(creators: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every member of every group with its resolved name; order by row_index."""
    # stored, as grouping, measuring and joining each read the keys
    keys = materialize(_member_keys(creators), "member-keys")
    return skew_join(keys, _groups(keys), SCOPE, "id", "inner", hot_rows).withColumnsRenamed(
        {"id": "creator_id", "resolved_first_name": "first_name",
         "resolved_last_name": "last_name"}
    )


def duplicate_pairs_to_merge(creators: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(source_id, target_id): every later member into the first of its group."""
    members = duplicate_members(creators, hot_rows)
    return members.where("creator_id <> first_creator_id").select(
        *SCOPE, "row_index", F.col("creator_id").alias("source_id"),
        F.col("first_creator_id").alias("target_id"),
    )
