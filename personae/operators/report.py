"""Read-side queries: statistics, lists, timelines, progress."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import LIST_LIMIT, PREVIEW_ROWS
from personae.functions import labels as L

TERMINAL = ["completed", "failed"]


def import_stats(creators: DataFrame) -> DataFrame:
    """Per import: processed, needs_review, cache_hits, duplicates (confirmed merges)."""
    return creators.groupBy("import_id").agg(
        F.count("*").alias("processed"),
        F.count_if("needs_review").alias("needs_review"),
        F.count_if(F.col("processing_status") == "cache_hit").alias("cache_hits"),
        F.count("duplicate_of_creator_id").alias("duplicates"),
    )


def by_import(creators: DataFrame, import_id: str) -> DataFrame:
    """Rows of one import in file order."""
    return creators.where(F.col("import_id") == import_id).orderBy("row_index")


def by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups as a batch: rows whose id is asked for, unknown ids drop out."""
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def preview(creators: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return creators.orderBy("row_index").limit(rows)


def review_list(creators: DataFrame, buckets: Iterable[str] = ()) -> DataFrame:
    """The nine columns of the review table plus the labels shown there."""
    first, last = F.col("resolved_first_name"), F.col("resolved_last_name")
    return L.filter_buckets(creators, buckets).select(
        "id",
        first.alias("first_name"),
        last.alias("last_name"),
        "confidence_score",
        "confidence_source",
        "processing_status",
        "needs_review",
        "review_status",
        "duplicate_of_creator_id",
        L.display_name(first, last).alias("name"),
        L.confidence_bucket(F.col("confidence_score")).alias("bucket"),
        L.evidence_label(F.col("confidence_source")).alias("evidence"),
        L.status_label(F.col("processing_status")).alias("status"),
    )


def shown_of_total(creators: DataFrame, buckets: Iterable[str]) -> DataFrame:
    """``n of m rows`` in one pass."""
    chosen = list(buckets)
    kept = L.confidence_bucket(F.col("confidence_score")).isin(chosen) if chosen else F.lit(True)
    return creators.groupBy("import_id").agg(
        F.count_if(kept).alias("shown"), F.count("*").alias("total")
    )


DETAIL = [
    "id", "resolved_first_name", "resolved_last_name", "resolved_display_name",
    "resolved_platform", "resolved_profile_url", "resolved_email",
    "resolved_social_handle", "confidence_score", "confidence_source",
    "processing_status", "needs_review", "review_status", "notes", "identity_cache_id",
    "duplicate_of_creator_id", "created_at", "updated_at",
]


def creator_detail(creators: DataFrame) -> DataFrame:
    return creators.select(*[F.col(c).alias(c.removeprefix("resolved_")) for c in DETAIL])


def log_timeline(logs: DataFrame) -> DataFrame:
    """Log rows per creator, oldest first (seq orders rows of one instant)."""
    return logs.orderBy("creator_id", "created_at", "seq")


def snapshot_timeline(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("creator_id", "fetched_at")


def creator_timeline(logs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Logs and snapshots of creators as one long table, one row per entry.

    Long rather than nested: a record's history has no bound. The range sort by
    (creator, section, time) splits even a single long history.
    """
    parts = logs.select(
        "creator_id", F.lit("log").alias("section"), F.col("created_at").alias("at"), "seq",
        F.col("step").alias("label"), "status", "detail",
    ).unionByName(
        snapshots.select(
            "creator_id", F.lit("snapshot").alias("section"), F.col("fetched_at").alias("at"),
            F.lit(0).alias("seq"), F.col("platform").alias("label"),
            F.col("fetched_via").alias("status"), F.col("raw_snapshot").alias("detail"),
        )
    )
    return parts.orderBy("creator_id", "section", "at", "seq")


def latest_log(logs: DataFrame, step: str) -> DataFrame:
    """The newest log row with that step per creator."""
    newest = F.max(F.struct("created_at", "seq", "id", "status", "detail")).alias("_l")
    return (
        logs.where(F.col("step") == step).groupBy("creator_id").agg(newest)
        .select("creator_id", "_l.*")
    )


def latest_per_step(logs: DataFrame) -> DataFrame:
    newest = F.max(F.struct("created_at", "seq", "status")).alias("_l")
    return logs.groupBy("creator_id", "step").agg(newest, F.count("*").alias("entries")).select(
        "creator_id", "step", "_l.*", "entries"
    )


def import_list(imports: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest imports with label and next action."""
    return imports.orderBy(F.desc("created_at"), "id").limit(limit).select(
        "id", "file_name", "row_count", "status", "created_at", "completed_at",
        L.import_status_label(F.col("status")).alias("status_label"),
        L.next_action(F.col("status")).alias("next_action"),
    )


def export_list(exports: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return exports.orderBy(F.desc("created_at"), "id").limit(limit)


# from the first to the last
IMPORT_STAGES = ["uploaded", "mapped", "processing", "completed", "failed"]


def update_import_status(imports: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """``updates`` (id, status, job_id): job_id kept if NULL, completed_at if not terminal.

    Of several updates of one import the one that is furthest along counts.
    """
    stages = F.array(*map(F.lit, IMPORT_STAGES))
    far = F.struct(F.array_position(stages, F.col("status")).alias("at"), "status", "job_id")
    new = updates.groupBy("id").agg(F.max(far).alias("_u")).select(
        "id", F.col("_u.status").alias("_status"), F.col("_u.job_id").alias("_job"),
        F.lit(True).alias("_hit"),
    )
    terminal = F.col("_status").isin(TERMINAL)
    return imports.join(new, "id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "job_id": F.coalesce("_job", "job_id"),
            "completed_at": F.when(terminal, now).otherwise(F.col("completed_at")),
        }
    ).drop("_status", "_job", "_hit").select(*imports.columns)


# --- progress and resume ---------------------------------------------------------


def resume_rows(creators: DataFrame, logs: DataFrame) -> DataFrame:
    """Records no run has finished yet."""
    finished = logs.where("step = 'final_selection'").select(F.col("creator_id").alias("id"))
    return creators.join(finished.distinct(), "id", "left_anti")


def next_unfinished(creators: DataFrame, logs: DataFrame) -> DataFrame:
    """Per import the first record that still has to run."""
    return resume_rows(creators, logs).groupBy("import_id").agg(
        F.min("row_index").alias("row_index"), F.min_by("id", "row_index").alias("id")
    )


def next_pending(job_items: DataFrame) -> DataFrame:
    """Per job the first pending or failed item."""
    open_items = job_items.where(F.col("status").isin("pending", "failed"))
    return open_items.groupBy("job_id").agg(
        F.min_by(F.struct("creator_id", "row_index", "status", "attempts"), "row_index")
        .alias("_i")
    ).select("job_id", "_i.*")


def job_progress(creators: DataFrame, logs: DataFrame) -> DataFrame:
    """Per import: progress counters and times, computed from the log."""
    per_record = logs.groupBy(F.col("creator_id").alias("id")).agg(
        F.count_if(F.col("step") == "final_selection").alias("runs"),
        F.min("created_at").alias("_from"),
        F.max("created_at").alias("_to"),
    )
    joined = creators.select("id", "import_id", "row_index").join(per_record, "id", "left")
    done = F.col("runs") > 0
    counts = joined.groupBy("import_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(done).alias("processed_rows"),
        F.coalesce(F.sum("runs"), F.lit(0)).alias("attempts"),
        F.coalesce(F.max(F.when(done, F.col("row_index"))), F.lit(-1))
        .alias("last_processed_row_index"),
        F.min("_from").alias("started_at"),
        F.max("_to").alias("_last"),
    )
    finished = F.col("processed_rows") == F.col("total_rows")
    return counts.withColumns(
        {
            "status": F.when(finished, "completed")
            .when(F.col("started_at").isNotNull(), "running").otherwise("queued"),
            "completed_at": F.when(finished, F.col("_last")),
        }
    ).drop("_last")
