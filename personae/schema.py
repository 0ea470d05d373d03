"""Table schemas and the creators defaults."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from personae.config import PIPELINE_VERSION

RESOLVED = [
    "first_name", "last_name", "display_name", "platform", "profile_url", "email",
    "social_handle",
]
RAW = ["raw_full_name", "raw_username", "raw_email", "raw_profile_url", "raw_platform"]
# columns a merge copies and an unmerge restores, besides resolved_*
IDENTITY_STATE = [
    "confidence_score", "confidence_source", "processing_status", "pipeline_version",
    "needs_review",
]


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _table(spec: str) -> T.StructType:
    columns = [column.split() for column in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


CREATORS = _table(
    "id string, import_id string, row_index bigint, "
    "raw_full_name string, raw_username string, raw_email string, "
    "raw_profile_url string, raw_platform string, raw_payload string, "
    "resolved_first_name string, resolved_last_name string, "
    "resolved_display_name string, resolved_platform string, "
    "resolved_profile_url string, resolved_email string, "
    "resolved_social_handle string, confidence_score int, confidence_source string, "
    "processing_status string, pipeline_version string, needs_review boolean, "
    "review_status string, notes string, identity_cache_id string, "
    "duplicate_of_creator_id string, created_at timestamp, updated_at timestamp"
)
IDENTITY_CACHE = _table(
    "id string, first_name string, last_name string, display_name string, "
    "platform string, profile_url string, email string, social_handle string, "
    "confidence_score int, confidence_source string, pipeline_version string, "
    "verified boolean, last_verified_at timestamp, created_at timestamp, "
    "updated_at timestamp"
)
IDENTITY_CACHE_KEYS = _table(
    "identity_cache_id string, key_type string, key_value string, created_at timestamp"
)
MANUAL_OVERRIDES = _table(
    "identity_cache_id string, field string, old_value string, new_value string, "
    "reason string, created_by string, created_at timestamp"
)
PROCESSING_LOGS = _table(
    "id string, creator_id string, job_id string, seq bigint, step string, "
    "status string, detail string, created_at timestamp"
)
PROFILE_SNAPSHOTS = _table(
    "id string, creator_id string, platform string, fetched_via string, "
    "raw_snapshot string, fetched_at timestamp"
)
IMPORT_HISTORY = _table(
    "id string, file_name string, file_type string, row_count bigint, "
    "column_mapping string, status string, job_id string, created_at timestamp, "
    "completed_at timestamp"
)
EXPORT_HISTORY = _table(
    "id string, import_id string, export_type string, filter_snapshot string, "
    "file_name string, row_count bigint, created_at timestamp"
)


def creator_id() -> Column:
    """Deterministic id, so a rerun or a retried task yields the same one."""
    return F.sha2(F.concat_ws("|", "import_id", F.col("row_index").cast("string")), 256)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``; columns the input lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def new_creators(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Creators rows as they stand right after ingest.

    ``rows`` has import_id, row_index and any of the raw columns.
    """
    now = F.current_timestamp() if now is None else now
    return conform(
        rows.withColumns(
            {
                "id": creator_id(),
                "processing_status": F.lit("failed"),
                "pipeline_version": F.lit(PIPELINE_VERSION),
                "needs_review": F.lit(False),
                "review_status": F.lit("pending"),
                "created_at": now,
                "updated_at": now,
            }
        ),
        CREATORS,
    )


def empty(spark, schema: T.StructType) -> DataFrame:
    """No rows, known to the optimizer as such."""
    return conform(spark.range(0), schema)


def literal_table(spark, rows: Iterable[Sequence], names: Sequence[str]) -> DataFrame:
    """A few driver-side rows as a literal, without a Python worker behind them."""
    entries = [
        F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))
