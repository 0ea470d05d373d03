"""Reviewer actions on batches of records.

Every function takes a table of actions and returns updated tables, the new log
rows and the rejected actions with a reason. Actions carry ``seq``, their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import OVERRIDABLE_FIELDS, PIPELINE_VERSION
from personae.functions.text import js_trim
from personae.operators.cache import create_identities, identity_id, resolved_or_raw
from personae.operators.scale import (
    HOT_ROWS,
    last_before,
    materialize,
    skew_join,
)
from personae.plans.enrich import log_rows
from personae.schema import (
    CREATORS,
    IDENTITY_CACHE,
    IDENTITY_CACHE_KEYS,
    MANUAL_OVERRIDES,
    RESOLVED,
    conform,
)


@dataclass
class ReviewResult:
    creators: DataFrame
    logs: DataFrame
    rejects: DataFrame
    identity_cache: DataFrame | None = None
    identity_cache_keys: DataFrame | None = None
    manual_overrides: DataFrame | None = None


def _with_existing(actions: DataFrame, creators: DataFrame, column: str, flag: str,
                   hot_rows: int) -> DataFrame:
    known = creators.select(F.col("id").alias(column), F.lit(True).alias(flag))
    return skew_join(actions, known, [column], "seq", "left", hot_rows)


def _in_order(actions: DataFrame, row_id: str, hot_rows: int) -> DataFrame:
    """Add ``_disorder``: why an action's place is unclear, NULL if it is not."""
    repeated = (
        actions.where("seq IS NOT NULL").groupBy("seq").agg(F.count("*").alias("_times"))
        .where("_times > 1")
    )
    placed = skew_join(actions, repeated, ["seq"], row_id, "left", hot_rows)
    return placed.withColumn(
        "_disorder",
        F.when(F.col("seq").isNull(), "seq_missing").when(F.col("_times") > 1, "seq_repeated"),
    ).drop("_times")


def _split(checked: DataFrame, reason: Column, drop: list[str]) -> tuple[DataFrame, DataFrame]:
    checked = checked.withColumn("reject_reason", reason).drop(*drop)
    return (
        checked.where("reject_reason IS NULL").drop("reject_reason"),
        checked.where("reject_reason IS NOT NULL"),
    )


def blank(c: Column) -> Column:
    return F.coalesce(js_trim(c), F.lit("")) == ""


def bulk_actions(creators: DataFrame, selected: Column, action: str, seq: int = 0) -> DataFrame:
    """One approve / ignore action for every selected record, with numbers from ``seq`` on."""
    return creators.where(selected).select(
        (F.lit(seq) + F.monotonically_increasing_id()).alias("seq"),
        F.col("id").alias("creator_id"),
        F.lit(action).alias("action"),
    )


# --- approve / ignore --------------------------------------------------------------


def apply_review(
    creators: DataFrame, actions: DataFrame, now: Column, run_id: str,
    hot_rows: int = HOT_ROWS,
) -> ReviewResult:
    """``actions`` (seq, creator_id, action): the last action per record decides."""
    ordered = _in_order(actions, "creator_id", hot_rows)
    checked = _with_existing(ordered, creators, "creator_id", "_known", hot_rows)
    reason = F.when(
        ~F.coalesce(F.col("action").isin("approve", "ignore"), F.lit(False)),
        "unknown_action",
    ).when(F.col("_known").isNull(), "no_such_record")
    good, bad = _split(checked, F.coalesce("_disorder", reason), ["_known", "_disorder"])
    state = F.when(F.col("action") == "approve", "approved").otherwise("ignored")
    last = good.groupBy(F.col("creator_id").alias("id")).agg(
        F.max_by(state, "seq").alias("_state")
    )
    updated = creators.join(last, "id", "left").withColumns(
        {
            "review_status": F.coalesce("_state", "review_status"),
            "updated_at": F.when(F.col("_state").isNotNull(), now)
            .otherwise(F.col("updated_at")),
        }
    )
    logs = log_rows(
        good.select(
            "creator_id", "seq",
            F.concat(F.lit("review_"), state).alias("step"), F.lit("success").alias("status"),
            F.lit(None).cast("string").alias("detail"),
        ),
        run_id, now,
    )
    return ReviewResult(conform(updated, CREATORS), logs, bad)


# --- manual overrides ---------------------------------------------------------------


def _last_per_field(actions: DataFrame, key: str) -> DataFrame:
    """One row per ``key`` with the last value of each field as o_<column>."""
    return actions.groupBy(key).agg(
        *[
            F.max_by("value", F.when(F.col("field") == name, F.col("seq"))).alias(f"o_{column}")
            for name, column in OVERRIDABLE_FIELDS.items()
        ]
    )


def apply_overrides(
    creators: DataFrame, identity_cache: DataFrame, identity_cache_keys: DataFrame,
    actions: DataFrame, now: Column, run_id: str, hot_rows: int = HOT_ROWS,
) -> ReviewResult:
    """``actions`` (seq, creator_id, field, value, reason): a human answer wins.

    The record and its cached identity both take the value; a record that was
    never cached first gets an identity of its own. Each action leaves an audit
    row with the value it replaced.
    """
    ordered = _in_order(actions, "creator_id", hot_rows)
    checked = _with_existing(ordered, creators, "creator_id", "_known", hot_rows)
    reason = (
        F.when(
            ~F.coalesce(F.col("field").isin(list(OVERRIDABLE_FIELDS)), F.lit(False)),
            "field_not_editable",
        )
        .when(blank(F.col("value")), "value_blank")
        .when(F.col("_known").isNull(), "no_such_record")
    )
    good, bad = _split(checked, F.coalesce("_disorder", reason), ["_known", "_disorder"])
    good = materialize(good, "override-actions")

    per_record = _last_per_field(good, "creator_id").join(
        good.groupBy("creator_id").agg(F.min("seq").alias("first_seq")), "creator_id"
    ).withColumnRenamed("creator_id", "id")
    joined = creators.join(per_record, "id", "left")
    touched = F.col("first_seq").isNotNull()
    joined = joined.withColumn(
        "_identity",
        F.when(touched, F.coalesce("identity_cache_id", identity_id(F.col("id")))),
    )
    joined = materialize(joined, "overridden")

    # identities for records that were never cached, from the values before the override
    fresh = joined.where(touched & F.col("identity_cache_id").isNull()).withColumns(
        {
            "write_identity_id": F.col("_identity"),
            "confidence_score": F.coalesce("confidence_score", F.lit(0)),
            "confidence_source": F.coalesce("confidence_source", F.lit("manual_override")),
            "pipeline_version": F.lit(PIPELINE_VERSION),
            "key_email": resolved_or_raw("resolved_email", "raw_email"),
            "key_username": resolved_or_raw("resolved_social_handle", "raw_username"),
            "key_profile_url": resolved_or_raw("resolved_profile_url", "raw_profile_url"),
        }
    )
    cache, keys = create_identities(
        identity_cache, identity_cache_keys, fresh, ["first_seq"], now
    )

    updated = joined.withColumns(
        {f"resolved_{c}": F.coalesce(f"o_{c}", f"resolved_{c}") for c in RESOLVED}
        | {
            "confidence_score": F.when(touched, 100).otherwise(F.col("confidence_score")),
            "confidence_source": F.when(touched, "manual_override")
            .otherwise(F.col("confidence_source")),
            "processing_status": F.when(touched, "enriched")
            .otherwise(F.col("processing_status")),
            "pipeline_version": F.when(touched, PIPELINE_VERSION)
            .otherwise(F.col("pipeline_version")),
            "needs_review": ~touched & F.col("needs_review"),
            "review_status": F.when(touched, "approved").otherwise(F.col("review_status")),
            "identity_cache_id": F.coalesce("_identity", "identity_cache_id"),
            "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
        }
    )

    # the value an action replaced: the previous action on the same field of the
    # record, else the record's own value
    numbered = last_before(
        materialize(good, "overrides"), ["creator_id", "field"], "seq", "value", "_previous", hot_rows
    )
    before = joined.where(touched).select(
        F.col("id").alias("creator_id"), F.col("_identity").alias("identity_cache_id"),
        *[F.col(f"resolved_{c}").alias(f"b_{c}") for c in RESOLVED],
    )
    original = F.lit(None).cast("string")
    for name, column in OVERRIDABLE_FIELDS.items():
        original = F.when(F.col("field") == name, F.col(f"b_{column}")).otherwise(original)
    history = skew_join(
        numbered, before, ["creator_id"], "seq", "inner", hot_rows
    ).withColumn("old_value", F.coalesce("_previous", original))
    audit = history.select(
        "identity_cache_id", "field", "old_value", F.col("value").alias("new_value"), "reason",
        F.lit("local-user").alias("created_by"), now.alias("created_at"), "seq",
    )
    detail = F.to_json(
        F.struct(
            "field", F.col("old_value").alias("oldValue"), F.col("value").alias("newValue"),
            "reason",
        )
    )
    logs = log_rows(
        history.select(
            "creator_id", "seq",
            F.lit("manual_override").alias("step"), F.lit("success").alias("status"),
            detail.alias("detail"),
        ),
        run_id, now,
    )
    return ReviewResult(
        conform(updated, CREATORS), logs, bad, _override_cache(cache, history, now),
        conform(keys, IDENTITY_CACHE_KEYS), conform(audit, MANUAL_OVERRIDES),
    )


def _override_cache(cache: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Set the last value per field of each identity and mark it verified."""
    changes = _last_per_field(history, "identity_cache_id").withColumnRenamed(
        "identity_cache_id", "id"
    ).withColumn("_changed", F.lit(True))
    changed = F.col("_changed").isNotNull()
    joined = cache.join(changes, "id", "left")
    return conform(
        joined.withColumns(
            {c: F.coalesce(f"o_{c}", c) for c in OVERRIDABLE_FIELDS.values()}
            | {
                "verified": changed | F.col("verified"),
                "last_verified_at": F.when(changed, now).otherwise(F.col("last_verified_at")),
                "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
            }
        ),
        IDENTITY_CACHE,
    )


# --- merge and unmerge --------------------------------------------------------------

_SNAPSHOT_FIELDS: dict[str, str] = {
    "resolvedFirstName": "resolved_first_name",
    "resolvedLastName": "resolved_last_name",
    "resolvedDisplayName": "resolved_display_name",
    "resolvedPlatform": "resolved_platform",
    "resolvedProfileUrl": "resolved_profile_url",
    "resolvedSocialHandle": "resolved_social_handle",
    "resolvedEmail": "resolved_email",
    "confidenceScore": "confidence_score",
    "confidenceSource": "confidence_source",
    "processingStatus": "processing_status",
    "pipelineVersion": "pipeline_version",
    "needsReview": "needs_review",
    "reviewStatus": "review_status",
    "identityCacheId": "identity_cache_id",
}
_TYPES = {f.name: f.dataType.simpleString() for f in CREATORS.fields}
_SNAPSHOT_SCHEMA = "preMergeSnapshot struct<" + ",".join(
    f"{name}:{_TYPES[column]}" for name, column in _SNAPSHOT_FIELDS.items()
) + ">"


def _snapshot() -> Column:
    """State of a record before a merge, with an absent score stored as 0."""
    return F.struct(
        *[
            (F.coalesce(c, F.lit(0)) if c == "confidence_score" else F.col(c)).alias(name)
            for name, c in _SNAPSHOT_FIELDS.items()
        ]
    )


_COPIED = [f"resolved_{c}" for c in RESOLVED] + [
    "confidence_score", "confidence_source", "processing_status", "pipeline_version",
]


def merge_duplicates(
    creators: DataFrame, pairs: DataFrame, now: Column, run_id: str,
    hot_rows: int = HOT_ROWS,
) -> ReviewResult:
    """``pairs`` (seq, source_id, target_id): the source takes over the target's identity.

    The result is that of running them one by one. A source gets what its target has at that
    moment, which may be what an earlier merge gave the target; where that began is found by
    pointer doubling over the merges, in steps that grow with the logarithm of the longest chain.
    """
    checked = _in_order(pairs, "source_id", hot_rows)
    checked = _with_existing(checked, creators, "source_id", "_source", hot_rows)
    checked = _with_existing(checked, creators, "target_id", "_target", hot_rows)
    reason = (
        F.when(blank(F.col("target_id")), "target_missing")
        .when(F.col("source_id") == F.col("target_id"), "target_is_source")
        .when(F.col("_source").isNull(), "no_such_record")
        .when(F.col("_target").isNull(), "no_such_target")
    )
    good, bad = _split(
        checked, F.coalesce("_disorder", reason), ["_source", "_target", "_disorder"]
    )
    todo = materialize(good.select("seq", "source_id", "target_id"), "merges")
    involved = todo.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    original = conform(creators, CREATORS)
    state = materialize(original.join(involved, "id", "left_semi"), "merge-state")
    merges = _forwarded(todo, state, hot_rows)
    merged = materialize(_merged(merges, state, hot_rows), "merged")
    last = merged.groupBy("id").agg(F.max("seq").alias("seq"))
    changed = conform(
        merged.join(last, ["id", "seq"], "left_semi").withColumn("updated_at", now), CREATORS
    )
    logs = merged.select(
        F.col("id").alias("creator_id"), "seq", F.lit("merged_duplicate").alias("step"),
        F.lit("success").alias("status"), "detail",
    )
    updated = original.join(last.select("id"), "id", "left_anti").unionByName(changed)
    return ReviewResult(updated, log_rows(logs, run_id, now), bad)


def _forwarded(todo: DataFrame, state: DataFrame, hot_rows: int) -> DataFrame:
    """Merges with ``before``, ``root_id`` and ``identity``.

    ``before``: the source's own merge before this one. ``root_id``: the record whose stored fields
    arrive at the source. ``identity``: the identity link the source then has, which is the
    target's or, where that has none, its own.
    """
    touched = todo.select(
        F.col("source_id").alias("id"), "seq", F.col("seq").alias("merge"), F.lit(True).alias("own")
    ).unionByName(
        todo.select(F.col("target_id").alias("id"), "seq", F.lit(None).cast("bigint").alias("merge"),
                    F.lit(False).alias("own"))
    )
    earlier = last_before(materialize(touched, "touched"), ["id"], "seq", "merge", "_earlier", hot_rows)
    earlier = earlier.groupBy("seq").agg(
        F.max(F.when(F.col("own"), F.col("_earlier"))).alias("before"),
        F.max(F.when(~F.col("own"), F.col("_earlier"))).alias("pointer"),
    )
    links = state.select(F.col("id").alias("source_id"), F.col("identity_cache_id").alias("_link"))
    merges = materialize(
        skew_join(todo.join(earlier, "seq"), links, ["source_id"], "seq", "left", hot_rows),
        "merge-links",
    )
    own, own_open = F.col("_link"), F.col("before").isNotNull()
    while True:
        # what the merge adds if the target comes without a link; open: not known yet
        steps = merges.select(
            "seq", "pointer", F.when(~own_open, own).alias("link"), own_open.alias("open"),
            F.when(F.col("pointer").isNull(), F.col("target_id")).alias("root_id"),
        )
        roots = state.select(
            F.col("id").alias("root_id"), F.col("identity_cache_id").alias("_root_link")
        )
        found = skew_join(_to_roots(steps, hot_rows), roots, ["root_id"], "seq", "left", hot_rows)
        unclear = F.col("_root_link").isNull() & F.col("open")
        found = materialize(
            found.select(
                "seq", "root_id", unclear.alias("unclear"),
                F.coalesce("_root_link", "link").alias("identity"),
            ), "merge-roots",
        )
        if found.where("unclear").isEmpty():
            known = merges.select("seq", "source_id", "target_id", "before")
            return materialize(known.join(found.drop("unclear"), "seq"), "forwarded")
        # merges of a source that was merged before wait for what that merge gave it
        settled = found.where("NOT unclear").select(
            F.col("seq").alias("before"), F.col("identity").alias("_before_link"),
            F.lit(True).alias("_settled"),
        )
        merges = materialize(
            skew_join(
                merges.drop("_before_link", "_settled"), settled, ["before"], "seq", "left", hot_rows
            ), "merge-links",
        )
        own = F.when(F.col("before").isNull(), F.col("_link")).otherwise(F.col("_before_link"))
        own_open = F.col("before").isNotNull() & F.col("_settled").isNull()


def _to_roots(steps: DataFrame, hot_rows: int) -> DataFrame:
    """Follow all pointers to their ends. Of the links on the way the farthest counts."""
    steps = materialize(steps, "merge-steps")
    while not steps.where("pointer IS NOT NULL").isEmpty():
        next_ = steps.select(
            F.col("seq").alias("pointer"), F.col("pointer").alias("_pointer"),
            F.col("link").alias("_link"), F.col("open").alias("_open"),
            F.col("root_id").alias("_root_id"),
        )
        on = F.col("pointer").isNotNull()
        joined = skew_join(steps, next_, ["pointer"], "seq", "left", hot_rows)
        steps = materialize(
            joined.select(
                "seq", F.col("_pointer").alias("pointer"),
                F.when(on & F.col("_open"), F.lit(None)).otherwise(F.coalesce("_link", "link"))
                .alias("link"),
                F.when(on, F.col("_open") | (F.col("_link").isNull() & F.col("open")))
                .otherwise(F.col("open")).alias("open"),
                F.when(on, F.col("_root_id")).otherwise(F.col("root_id")).alias("root_id"),
            ), "merge-steps",
        )
    return steps


def _merged(merges: DataFrame, state: DataFrame, hot_rows: int) -> DataFrame:
    """The source of each merge as the merge leaves it, with ``seq`` and the log's ``detail``."""
    score = "confidence_score"

    def fields(key: str, prefix: str) -> DataFrame:
        return state.select(
            F.col("id").alias(key),
            *[(F.coalesce(c, F.lit(0)) if c == score else F.col(c)).alias(f"{prefix}{c}")
              for c in _COPIED],
        )

    rows = skew_join(
        merges.withColumnRenamed("source_id", "id"), state, ["id"], "seq", "inner", hot_rows
    )
    rows = skew_join(rows, fields("root_id", "t_"), ["root_id"], "seq", "inner", hot_rows)
    again = merges.where("before IS NOT NULL").select("before")
    if not again.isEmpty():
        # the state that an earlier merge left
        earlier = merges.join(again.withColumnRenamed("before", "seq"), "seq", "left_semi").select(
            F.col("seq").alias("before"), F.col("root_id").alias("_root"),
            F.col("identity").alias("_identity"), F.col("target_id").alias("_target"),
        )
        earlier = skew_join(earlier, fields("_root", "p_"), ["_root"], "before", "inner", hot_rows)
        rows = skew_join(rows, earlier, ["before"], "seq", "left", hot_rows)
        on = F.col("before").isNotNull()
        left = {c: F.col(f"p_{c}") for c in _COPIED} | {
            "identity_cache_id": F.col("_identity"), "duplicate_of_creator_id": F.col("_target"),
            "needs_review": F.lit(False), "review_status": F.lit("approved"),
        }
        rows = rows.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in left.items()})
    detail = F.to_json(
        F.struct(
            F.col("target_id").alias("targetCreatorId"), _snapshot().alias("preMergeSnapshot")
        )
    )
    return rows.withColumn("detail", detail).withColumns(
        {c: F.col(f"t_{c}") for c in _COPIED}
        | {
            "identity_cache_id": F.col("identity"),
            "needs_review": F.lit(False),
            "review_status": F.lit("approved"),
            "duplicate_of_creator_id": F.col("target_id"),
        }
    )


def unmerge(
    creators: DataFrame, logs: DataFrame, requests: DataFrame, now: Column,
    run_id: str, hot_rows: int = HOT_ROWS,
) -> ReviewResult:
    """``requests`` (seq, creator_id): undo the latest merge of each record.

    The identity link keeps the target's value when the snapshot had none: links
    are replaced, never cleared.
    """
    current = creators.select(
        F.col("id").alias("creator_id"), F.lit(True).alias("_known"),
        F.col("duplicate_of_creator_id").alias("_duplicate_of"),
    )
    newest = F.max(F.struct("created_at", "seq", "id", "detail")).alias("_l")
    merges = (
        logs.where("step = 'merged_duplicate'").groupBy("creator_id").agg(newest)
        .select(
            "creator_id",
            F.col("_l.id").alias("_log_id"),
            F.from_json("_l.detail", _SNAPSHOT_SCHEMA)["preMergeSnapshot"].alias("_snapshot"),
        )
    )
    state = current.join(merges, "creator_id", "left")
    ordered = _in_order(requests, "creator_id", hot_rows)
    checked = skew_join(ordered, state, ["creator_id"], "seq", "left", hot_rows)
    first = ordered.where("_disorder IS NULL").groupBy("creator_id").agg(
        F.min("seq").alias("_first_seq")
    )
    checked = skew_join(checked, first, ["creator_id"], "seq", "left", hot_rows)
    reason = (
        F.when(F.col("_known").isNull(), "no_such_record")
        .when(
            F.col("_duplicate_of").isNull() | (F.col("seq") > F.col("_first_seq")),
            "not_merged",
        )
        .when(F.col("_log_id").isNull(), "no_merge_on_record")
        .when(F.col("_snapshot").isNull(), "merge_without_state")
    )
    good, bad = _split(
        checked, F.coalesce("_disorder", reason),
        ["_known", "_duplicate_of", "_first_seq", "_disorder"],
    )
    restore = good.select(
        F.col("creator_id").alias("id"), F.col("seq").alias("_seq"), "_log_id", "_snapshot"
    )
    joined = conform(creators, CREATORS).join(restore, "id", "left")
    hit = F.col("_seq").isNotNull()
    restored = {
        column: F.when(hit, F.col(f"_snapshot.{name}")).otherwise(F.col(column))
        for name, column in _SNAPSHOT_FIELDS.items()
    }
    restored["identity_cache_id"] = F.coalesce(
        F.col("_snapshot.identityCacheId"), F.col("identity_cache_id")
    )
    restored["duplicate_of_creator_id"] = F.when(~hit, F.col("duplicate_of_creator_id"))
    restored["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    new_logs = log_rows(
        good.select(
            "creator_id", "seq",
            F.lit("unmerged_duplicate").alias("step"), F.lit("success").alias("status"),
            F.to_json(F.struct(F.col("_log_id").alias("restoredFrom"))).alias("detail"),
        ),
        run_id, now,
    )
    return ReviewResult(
        conform(joined.withColumns(restored), CREATORS), new_logs,
        bad.drop("_log_id", "_snapshot"),
    )
