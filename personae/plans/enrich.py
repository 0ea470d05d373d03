"""Enrichment of imports: evidence, cache, one winner per record, audit log."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import (
    DEFAULT_DESCRIPTORS,
    DEFAULT_WEIGHTS,
    Descriptors,
    PIPELINE_VERSION,
    Weights,
)
from personae.operators import cache as C
from personae.operators import extract as X
from personae.operators.dictionary import NameDictionary
from personae.operators.normalize import normalize_records
from personae.operators.profile import PAGE_FIELDS, attach_pages, with_profile_candidate
from personae.operators.scale import HOT_ROWS, materialize, skew_join
from personae.operators.score import demote_conflicts, fill_from_input, score
from personae.plans.sequential import decide_in_order
from personae.schema import (
    CREATORS,
    IDENTITY_CACHE,
    IDENTITY_CACHE_KEYS,
    IDENTITY_STATE,
    PROCESSING_LOGS,
    PROFILE_SNAPSHOTS,
    RESOLVED,
    conform,
    empty,
)

CONFLICT = "conflicting_identity_cache_matches"
NORMALIZED = ["n_full_name", "n_username", "n_email", "n_profile_url", "n_platform"]
CANDIDATE_COLUMNS = ["cand_full_name", "cand_username", "cand_email", "cand_profile"]
# columns of the evidence: for logs and snapshots, for the result, and on the way to it
DETAILS = [
    *NORMALIZED, *CANDIDATE_COLUMNS, "scrape_platform", "scrape_error", "raw_snapshot", "fetched_via",
]
OUTCOME_ONLY = [
    "w_confidence_score", "w_confidence_source", "w_processing_status", "w_pipeline_version",
    "w_needs_review",
]
OUTCOME = [*[f"resolved_{f}" for f in RESOLVED], *OUTCOME_ONLY]


@dataclass
class EnrichResult:
    creators: DataFrame             # same rows as the input, resolved
    logs: DataFrame                 # new processing_logs rows
    snapshots: DataFrame            # new profile_snapshots rows
    new_identities: DataFrame       # rows to append to identity_cache
    new_keys: DataFrame             # rows to append to identity_cache_keys

    def summary(self) -> DataFrame:
        return run_summary(self.creators, self.logs)


def record_error() -> Column:
    """Why a record cannot be processed, NULL if it can."""
    return (
        F.when(F.col("id").isNull(), "id is missing")
        .when(F.col("import_id").isNull(), "import_id is missing")
        .when(F.col("row_index").isNull(), "row_index is missing")
    )


def _without_repeats(incoming: DataFrame, hot_rows: int) -> DataFrame:
    """Records that share an id are errors: which of them a result belongs to is unclear."""
    good = incoming.where("record_error IS NULL").select("id", F.xxhash64("id").alias("_hash"))
    # hashes are shuffled instead of ids; of the few that repeat, ids tell whether they do
    shared = materialize(
        good.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash"),
        "repeated-hashes",
    )
    if shared.isEmpty():
        return incoming
    repeated = materialize(
        good.join(shared, "_hash", "left_semi").groupBy("id").agg(F.count("*").alias("_times"))
        .where("_times > 1"),
        "repeated-ids",
    )
    if repeated.isEmpty():
        return incoming
    marked = skew_join(incoming, repeated, ["id"], "row_index", "left", hot_rows)
    error = F.coalesce("record_error", F.when(F.col("_times") > 1, "id is repeated"))
    return marked.withColumn("record_error", error).drop("_times")


def gather_candidates(
    records: DataFrame, dictionary: NameDictionary, pages: DataFrame | None = None,
    weights: Weights = DEFAULT_WEIGHTS, hot_rows: int = HOT_ROWS,
    descriptors: Descriptors = DEFAULT_DESCRIPTORS,
) -> DataFrame:
    """All candidates of normalized records, one column per source."""
    # pages first: their join measures its keys on the records as they come in
    df = attach_pages(records, pages, hot_rows=hot_rows)
    if pages is None:
        df = df.withColumns(
            {
                "scrape_platform": F.lit(None).cast("string"),
                "scrape_error": F.lit(None).cast("string"),
                "raw_snapshot": F.lit(None).cast("string"),
                "cand_profile": F.lit(None).cast(X.CANDIDATE_TYPE),
            }
        )
    else:
        df = _set_aside(df, ["id", "n_profile_url", *PAGE_FIELDS, "has_page"])
        df = _taken_back(
            with_profile_candidate(df, dictionary, weights=weights, descriptors=descriptors)
        )
    df = _set_aside(df, ["id", "n_full_name", "n_username", "n_email"])
    df = X.with_username_candidate(df, dictionary, weights=weights, descriptors=descriptors)
    df = X.with_email_candidate(df, dictionary, weights=weights)
    return _taken_back(X.with_full_name_candidate(df, weights=weights))


def _set_aside(df: DataFrame, needed: list[str]) -> DataFrame:
    """``needed`` as they are, all other columns as one: every lookup copies its rows."""
    rest = [F.col(c) for c in df.columns if c not in needed]
    return df.select(*needed, F.struct(*rest).alias("_aside"))


def _taken_back(df: DataFrame) -> DataFrame:
    rest = df.schema["_aside"].dataType.names
    return df.select(
        *[c for c in df.columns if c != "_aside"], *[F.col("_aside")[c].alias(c) for c in rest]
    )


def _hide_hits(df: DataFrame) -> DataFrame:
    """Cache hits skip extraction: their normalized input reads as absent.

    The expressions and joins behind it are NULL-in NULL-out, so a hit costs next
    to nothing there. The true values stay in k_* for the log.
    """
    hit = F.col("cache_status") == "hit"
    return df.withColumns({f"k{n[1:]}": F.col(n) for n in NORMALIZED}).withColumns(
        {n: F.when(~hit, F.col(n)) for n in NORMALIZED}
    )


def _show_hits(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c.startswith("k_")]
    return df.withColumns({f"n{k[1:]}": F.col(k) for k in names}).drop(*names)


def enrich(
    creators: DataFrame, dictionary: NameDictionary,
    identity_cache: DataFrame | C.Stored | None = None,
    identity_cache_keys: DataFrame | C.Stored | None = None,
    pages: DataFrame | None = None, mode: str = "sequential",
    weights: Weights = DEFAULT_WEIGHTS, import_order: Column | None = None,
    run_id: str | None = None, now: Column | None = None, hot_rows: int = HOT_ROWS,
    descriptors: Descriptors = DEFAULT_DESCRIPTORS,
) -> EnrichResult:
    """Resolve every record of the given imports.

    ``sequential`` gives each record the cache as left by all earlier records
    (imports by ``import_order``, else by their arrival, rows by row_index). ``snapshot`` looks
    everything up in the cache as of batch start: one pass, made for streams. Log ids hold
    ``run_id``: give one that a repeated run can use again, else it is a new one.
    """
    run_id = f"run-{uuid.uuid4().hex}" if run_id is None else run_id
    if mode not in ("sequential", "snapshot"):
        raise ValueError(f"unknown mode: {mode}")
    spark = creators.sparkSession
    now = F.current_timestamp() if now is None else now
    cache = empty(spark, IDENTITY_CACHE) if identity_cache is None else identity_cache
    keys = empty(spark, IDENTITY_CACHE_KEYS) if identity_cache_keys is None else identity_cache_keys
    rank = F.struct("created_at", "import_id") if import_order is None else import_order

    incoming = conform(creators, CREATORS).withColumn("record_error", record_error())
    incoming = _without_repeats(incoming, hot_rows)
    # only keys and normalized text go through the run; everything else a record
    # carries (its payload above all) waits in ``creators`` for the last join
    records = normalize_records(incoming.where("record_error IS NULL"), descriptors).select(
        "id", "import_id", "row_index", rank.alias("import_rank"), *NORMALIZED
    )
    # normalized once: the lookup and the joins to come measure keys before they use them
    records = materialize(records, "normalized")
    if mode == "snapshot":
        records = _hide_hits(C.lookup(records, keys, hot_rows=hot_rows))
    evidence = gather_candidates(records, dictionary, pages, weights, hot_rows, descriptors)
    if mode == "snapshot":
        evidence = _show_hits(evidence)
    # resolved_* are rebuilt here; cached fields replace them for hits below
    evidence = fill_from_input(score(evidence, CANDIDATE_COLUMNS, weights))
    wanted = {"id", "import_rank", "row_index", "cache_status", "matched_ids", *OUTCOME, *DETAILS}
    evidence = materialize(
        evidence.select(*[c for c in evidence.columns if c in wanted]), "evidence"
    )

    # what the cache says about a record is worked out on narrow rows and joined to
    # the wide evidence once
    hit_id = F.when(F.col("cache_status") == "hit", F.get("matched_ids", F.lit(0)))
    if mode == "snapshot":
        writers = evidence.where("cache_status = 'miss' AND w_processing_status = 'enriched'")
        writes = C.plan_writes(writers, keys, ["import_rank", "row_index"], hot_rows=hot_rows)
        new_keys = writes.new_keys
        hits = evidence.where("cache_status = 'hit'").select("id", hit_id.alias("hit_id"))
        outcome = C.attach_identities(hits, cache, "hit_id", hot_rows=hot_rows).unionByName(
            writes.decisions, allowMissingColumns=True
        )
    else:
        order = F.struct("import_rank", "row_index")
        decisions, written = decide_in_order(evidence, keys, order, hot_rows)
        new_keys = written.select(*C.KEY, "identity_cache_id")
        creates = decisions.where("write_action = 'create'").select("id", "write_identity_id")
        created = materialize(
            C.new_identities(_fresh_result(evidence.join(creates, "id")), now), "created"
        )
        known = C.matching(cache, decisions.select(hit_id.alias("id")))
        visible = conform(known, IDENTITY_CACHE).unionByName(created)
        outcome = C.attach_identities(
            decisions.withColumn("hit_id", hit_id), visible, "hit_id", hot_rows=hot_rows
        )
    # what only logs and snapshots show stays behind until they are read
    joined = evidence.drop(*DETAILS).join(outcome, "id", "left").withColumn(
        "cache_status", F.coalesce("cache_status", F.lit("miss"))
    )
    final = _apply_hits(_fresh_result(joined))
    final = materialize(final.drop("import_rank", "row_index", *OUTCOME_ONLY), "enriched")

    untouched = incoming.where("record_error IS NOT NULL")
    details = evidence.select("id", *DETAILS)
    logs = processing_logs(final.join(details, "id"), run_id, now).unionByName(
        _error_logs(untouched, run_id, now)
    )
    return EnrichResult(
        creators=_updated_creators(incoming, final, now),
        logs=logs,
        snapshots=_snapshots(final, details, run_id, now),
        new_identities=C.new_identities(final.where("write_action = 'create'"), now),
        new_keys=conform(new_keys.withColumn("created_at", now), IDENTITY_CACHE_KEYS),
    )


def _fresh_result(df: DataFrame) -> DataFrame:
    """The winner's scores, after conflict demotion where the lookup is known."""
    status = F.col("w_processing_status")
    if "cache_status" in df.columns:
        status = demote_conflicts(status, F.col("cache_status") == "conflict")
    return df.withColumns(
        {
            "confidence_score": F.col("w_confidence_score"),
            "confidence_source": F.col("w_confidence_source"),
            "processing_status": status,
            "pipeline_version": F.col("w_pipeline_version"),
            "needs_review": F.col("w_needs_review") | (status == "needs_review"),
        }
    )


def _apply_hits(final: DataFrame) -> DataFrame:
    """A hit copies the cached identity and is done."""
    hit = F.col("cache_status") == "hit"

    def pick(cached: Column, fresh: str) -> Column:
        return F.when(hit, cached).otherwise(F.col(fresh))

    columns = {f"resolved_{f}": pick(F.col(f"c_{f}"), f"resolved_{f}") for f in RESOLVED}
    columns |= {
        "confidence_score": pick(
            F.coalesce(F.col("c_confidence_score"), F.lit(100)), "confidence_score"
        ),
        "confidence_source": pick(F.col("c_confidence_source"), "confidence_source"),
        "processing_status": pick(F.lit("cache_hit"), "processing_status"),
        "pipeline_version": pick(F.lit(PIPELINE_VERSION), "pipeline_version"),
        "needs_review": ~hit & F.col("needs_review"),
        "write_action": F.when(~hit, F.col("write_action")),
        "write_identity_id": F.when(~hit, F.col("write_identity_id")),
    }
    return final.withColumns(columns).drop(*[c for c in final.columns if c.startswith("c_")])


def _updated_creators(creators: DataFrame, final: DataFrame, now: Column) -> DataFrame:
    """Write the results over the records; records that were not run stay as they are."""
    changed = [*[f"resolved_{f}" for f in RESOLVED], *IDENTITY_STATE]
    results = final.select(
        "id", F.lit(True).alias("_run"), "hit_id", "write_identity_id",
        *[F.col(c).alias(f"_{c}") for c in changed],
    )
    run = F.col("_run").isNotNull()
    columns = {c: F.when(run, F.col(f"_{c}")).otherwise(F.col(c)) for c in changed}
    # an identity link is only ever replaced, never cleared
    columns["identity_cache_id"] = F.coalesce(
        "hit_id", "write_identity_id", "identity_cache_id"
    )
    columns["updated_at"] = F.when(run, now).otherwise(F.col("updated_at"))
    return conform(creators.join(results, "id", "left").withColumns(columns), CREATORS)


# --- audit log ---------------------------------------------------------------------


def processing_logs(final: DataFrame, run_id: str, now: Column) -> DataFrame:
    """3 rows for a hit, else 8, or 9 with a profile URL; one pass over ``final``."""
    status, has_url = F.col("cache_status"), F.col("scrape_platform").isNotNull()
    hit, conflict = status == "hit", status == "conflict"
    nothing = F.lit(None).cast("string")

    def entry(seq: int, when: Column, step: str | Column, state: str | Column,
              detail: Column) -> Column:
        as_column = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.when(
            when,
            F.struct(
                F.lit(seq).alias("seq"), as_column(step).alias("step"),
                as_column(state).alias("status"), detail.alias("detail"),
            ),
        )

    def parsed(seq: int, step: str, column: str) -> Column:
        found = F.col(column).isNotNull()
        return entry(seq, ~hit, step, F.when(found, "success").otherwise("skipped"),
                     X.candidate_json(F.col(column)))

    normalized = F.to_json(
        F.struct(
            F.col("n_full_name").alias("fullName"), F.col("n_username").alias("username"),
            F.col("n_email").alias("email"), F.col("n_profile_url").alias("profileUrl"),
            F.col("n_platform").alias("platform"),
        )
    )
    conflict_detail = F.to_json(
        F.struct(F.lit(CONFLICT).alias("reason"), F.col("matched_ids").alias("identityCacheIds"))
    )
    scraped = F.when(F.col("scrape_error").isNotNull(), "failed").when(
        F.col("cand_profile").isNotNull(), "success"
    ).otherwise("skipped")
    names = F.to_json(
        F.struct(F.col("resolved_first_name").alias("firstName"),
                 F.col("resolved_last_name").alias("lastName"))
    )
    cached_names = F.to_json(
        F.struct(F.col("resolved_first_name").alias("firstName"),
                 F.col("resolved_last_name").alias("lastName")),
        {"ignoreNullFields": "false"},
    )
    wrote = F.col("write_identity_id").isNotNull()
    identity = lambda c: F.to_json(F.struct(F.col(c).alias("identityCacheId")))
    always = F.lit(True)
    entries = [
        entry(1, always, "normalized", "success", normalized),
        entry(2, always, "cache_lookup",
              F.when(hit, "success").when(conflict, "failed").otherwise("skipped"),
              F.when(hit, identity("hit_id")).when(conflict, conflict_detail)),
        parsed(3, "parsed_full_name", "cand_full_name"),
        parsed(4, "parsed_username", "cand_username"),
        parsed(5, "parsed_email", "cand_email"),
        entry(6, ~hit & has_url,
              F.concat(F.lit("scraped_profile_"), F.col("scrape_platform")), scraped,
              F.coalesce(
                  F.when(F.col("scrape_error").isNotNull(),
                         F.to_json(F.struct(F.col("scrape_error").alias("error")))),
                  X.candidate_json(F.col("cand_profile")),
              )),
        entry(7, ~hit, "confidence_calculated", "success",
              F.to_json(F.struct(
                  F.col("confidence_score").alias("confidenceScore"),
                  F.col("confidence_source").alias("confidenceSource"),
                  F.col("processing_status").alias("processingStatus")))),
        entry(8, ~hit, "cache_write", F.when(wrote, "success").otherwise("skipped"),
              F.when(wrote, identity("write_identity_id"))
              .when(conflict, F.to_json(F.struct(F.lit(CONFLICT).alias("reason"))))
              .otherwise(nothing)),
        entry(9, always, "final_selection",
              F.when(F.col("processing_status") == "failed", "failed").otherwise("success"),
              F.when(hit, cached_names).otherwise(names)),
    ]
    rows = final.select("id", F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return log_rows(
        rows.select(F.col("id").alias("creator_id"), "e.seq", "e.step", "e.status", "e.detail"),
        run_id, now,
    )


def log_rows(rows: DataFrame, run_id: str, now: Column) -> DataFrame:
    """(creator_id, seq, step, status, detail) as processing_logs rows."""
    return conform(
        rows.withColumns(
            {
                "id": F.sha2(F.concat_ws("|", F.lit(run_id), "creator_id", "seq", "step"), 256),
                "job_id": F.lit(run_id),
                "created_at": now,
            }
        ),
        PROCESSING_LOGS,
    )


def _error_logs(bad: DataFrame, run_id: str, now: Column) -> DataFrame:
    return log_rows(
        bad.select(
            F.col("id").alias("creator_id"), F.lit(1).alias("seq"),
            F.lit("enrich_one").alias("step"), F.lit("failed").alias("status"),
            F.to_json(F.struct(F.col("record_error").alias("error"))).alias("detail"),
        ),
        run_id, now,
    )


def _snapshots(final: DataFrame, details: DataFrame, run_id: str, now: Column) -> DataFrame:
    # a record answered by the cache has not looked at its page
    looked = final.where("cache_status != 'hit'").select("id")
    return conform(
        details.where("raw_snapshot IS NOT NULL AND fetched_via IS NOT NULL")
        .join(looked, "id", "left_semi").select(
            F.sha2(F.concat_ws("|", F.lit(run_id), "id", F.lit("snapshot")), 256).alias("id"),
            F.col("id").alias("creator_id"), F.col("scrape_platform").alias("platform"),
            "fetched_via", "raw_snapshot", now.alias("fetched_at"),
        ),
        PROFILE_SNAPSHOTS,
    )


def run_summary(creators: DataFrame, logs: DataFrame) -> DataFrame:
    """processed / failed rows of a run."""
    processed = creators.agg(F.count("*").alias("processed"))
    failed = logs.agg(
        F.count_if((F.col("step") == "enrich_one") & (F.col("status") == "failed"))
        .alias("failed")
    )
    return processed.withColumn("failed", failed.scalar())
