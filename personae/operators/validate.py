"""Row validation: enumerations, ranges and required columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae import config as K


@dataclass(frozen=True)
class Rules:
    required: list[str] = field(default_factory=list)
    one_of: dict[str, list[str]] = field(default_factory=dict)
    between: dict[str, tuple[int, int]] = field(default_factory=dict)


RULES: dict[str, Rules] = {
    "creators": Rules(
        required=["id", "import_id", "row_index", "processing_status", "pipeline_version",
                  "needs_review", "review_status"],
        one_of={
            "confidence_source": K.CONFIDENCE_SOURCES,
            "processing_status": K.PROCESSING_STATUSES,
            "review_status": K.REVIEW_STATUSES,
        },
        between={"confidence_score": (0, 100)},
    ),
    "import_history": Rules(
        required=["id", "file_name", "file_type", "row_count", "status", "created_at"],
        one_of={"file_type": K.FILE_TYPES, "status": K.IMPORT_STATUSES},
    ),
    "identity_cache": Rules(
        required=["id", "pipeline_version", "verified"],
        one_of={"confidence_source": K.CONFIDENCE_SOURCES},
        between={"confidence_score": (0, 100)},
    ),
    "identity_cache_keys": Rules(
        required=["identity_cache_id", "key_type", "key_value"],
        one_of={"key_type": K.KEY_TYPES},
    ),
    "manual_overrides": Rules(required=["identity_cache_id", "field", "created_by"]),
    "profile_snapshots": Rules(
        required=["id", "creator_id", "platform", "fetched_via", "raw_snapshot"],
        one_of={"fetched_via": K.FETCHED_VIA},
    ),
    "processing_logs": Rules(
        required=["id", "creator_id", "step", "status", "created_at"],
        one_of={"status": K.LOG_STATUSES},
    ),
    "export_history": Rules(
        required=["id", "export_type", "file_name", "row_count"],
        one_of={"export_type": K.EXPORT_TYPES},
    ),
}


def violations(rules: Rules) -> Column:
    """array<string> of broken rules, in rule order; NULL passes a range or enum."""
    checks = [
        F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in rules.required
    ]
    checks += [
        F.when(~F.col(c).isin(allowed), F.lit(f"{c}: not allowed"))
        for c, allowed in rules.one_of.items()
    ]
    checks += [
        F.when(~F.col(c).between(low, high), F.lit(f"{c}: out of range"))
        for c, (low, high) in rules.between.items()
    ]
    return F.array_compact(F.array(*checks))


def validate(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their violations)."""
    checked = df.withColumn("violations", violations(rules))
    bad = F.size("violations") > 0
    return checked.where(~bad).drop("violations"), checked.where(bad)
