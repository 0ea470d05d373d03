"""One query per operator, over whole tables.

Results are flat: ids and lists as strings, counts as bigint, flags as 0/1, times as
text, so that the row hashes of two engines can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as X
from personae import config as K
from personae.functions import labels as L
from personae.functions import text as T
from personae.functions.keys import canonical_profile_url, platform_of
from personae.operators import cache as C
from personae.operators import dedupe as D
from personae.operators import extract as E
from personae.operators import integrity as I
from personae.operators import profile as P
from personae.operators import report as R
from personae.operators import review as V
from personae.operators.normalize import normalize_records
from personae.operators.scale import scratch_dir
from personae.operators.score import fill_from_input, score
from personae.operators.validate import RULES, validate
from personae.plans import export as O
from personae.plans.enrich import CANDIDATE_COLUMNS, EnrichResult, enrich, gather_candidates
from personae.schema import IDENTITY_CACHE as R_CACHE
from personae.schema import IDENTITY_CACHE_KEYS as R_KEYS
from personae.schema import IMPORT_HISTORY as R_IMPORTS
from personae.schema import literal_table
from personae.sources import imports as S
from personae.sources import mapping as M
from personae.sources.pages import usable_pages
from personae.streaming.incremental import IncrementalEnrichment

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def flag(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def number(c: str) -> Column:
    """Nullable number as text."""
    return F.col(c).cast("string")


def moment(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


def normalized(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    return normalize_records(X.creators(spark, sf_dir, stored))


def static_and_browser_pages(
    spark: SparkSession, sf_dir: str, stored: bool = False
) -> DataFrame:
    pages = X.profile_pages(spark, sf_dir, stored)
    return usable_pages(
        pages.select("url", "html"), pages.where("copy = 'browser'").select("url", "html")
    )


# --- sources ------------------------------------------------------------------------


@query
def ingest_payload(spark, sf_dir):
    """Rows of a table as imports: JSON payload, number per import, initial state."""
    orders = X.read(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderkey", F.col("o_orderstatus").alias("Status"),
        F.col("o_custkey").cast("string").alias("Customer"),
    )
    rows = S.ingest_table(
        orders, "o_orderpriority", ["o_orderkey"], ["Status", "Customer"], X.now()
    )
    return rows.select(
        "id", "import_id", "row_index", "raw_payload", "processing_status", "review_status",
        "pipeline_version", flag("needs_review").alias("needs_review"),
    )


@query
def payload_fields(spark, sf_dir):
    """JSON payload written and read back through a mapping."""
    sheet = X.sheet(spark, sf_dir).withColumn(
        "raw_payload", S.payload([*X.SHEET_MAPPING, "Notes"])
    )
    back = M.apply_mapping_to_payload(sheet, X.SHEET_MAPPING)
    notes = F.get_json_object("raw_payload", "$.Notes").alias("notes")
    return back.select("row_index", "raw_full_name", "raw_email", "raw_username", notes)


@query
def ingest_csv(spark, sf_dir):
    """A CSV import with line breaks in cells, scanned in splits and numbered in file order."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    sheet = X.sheet(spark, sf_dir).withColumn("Bio", F.expr(X.BIO))
    sheet.orderBy("row_index").drop("row_index").write.options(**O.CSV_OPTIONS).csv(path)
    result = S.ingest_csv(spark, path, "sheet", X.now(), "sheet.csv")
    mapping = M.suggested_mapping(spark, result.headers)
    return M.apply_mapping_to_payload(result.creators, mapping).select(
        "import_id", "row_index", "raw_full_name", "raw_username", "raw_email",
        "raw_profile_url", F.get_json_object("raw_payload", "$.Bio").alias("bio"),
    )


@query
def csv_quarantine(spark, sf_dir):
    """One file for each priority, with bytes that are no text and a quote that is never closed."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    lines = spark.sql(X.DAMAGED_CSV, orders=X.read(spark, sf_dir, "orders"))
    (lines.repartition("priority").sortWithinPartitions("priority", "at", "nth")
     .select("priority", "line").write.partitionBy("priority").text(path))
    found = S.read_csv(spark, path)
    priority = F.url_decode(F.regexp_extract("file", "priority=([^/]*)/", 1)).alias("priority")
    good = found.rows.groupBy(priority).agg(
        F.lit(0).cast("bigint").alias("line"), F.count("*").cast("string").alias("raw"),
        F.lit("rows").alias("reason"), F.lit(1).cast("bigint").alias("kept"),
    )
    return good.unionByName(
        found.rejects.select(priority, "line", "raw", "reason", flag("kept").alias("kept"))
    )


@query
def file_routing(spark, sf_dir):
    """File names to readers and rejects."""
    names = X.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.concat(
            "o_orderpriority",
            F.element_at(F.array(*map(F.lit, [".CSV", ".xlsx", ".xls", ".txt"])),
                         (F.col("o_orderkey") % 4 + 1).cast("int")),
        ).alias("file_name"),
    )
    good, bad = S.route_files(names)
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select(
        "k", "file_name", "file_type", "reject_reason"
    )


@query
def suggest_mapping(spark, sf_dir):
    return M.suggest_mapping(X.derived(spark, sf_dir, X.HEADERS))


@query
def apply_mapping(spark, sf_dir):
    return M.apply_mapping(X.sheet(spark, sf_dir), X.SHEET_MAPPING).select(
        "row_index", "raw_full_name", "raw_username", "raw_email", "raw_profile_url",
        "raw_platform",
    )


@query
def edited_mapping(spark, sf_dir):
    mapping = M.edit_mapping(X.SHEET_MAPPING, {"Instagram": None, "Notes": "fullName"})
    return M.apply_mapping(X.sheet(spark, sf_dir), mapping).select(
        "row_index", "raw_full_name", "raw_profile_url"
    )


@query
def confirm_mapping(spark, sf_dir):
    """Mapping confirmed for one import: new state of the import and the preview."""
    sheet = X.sheet(spark, sf_dir)
    creators = sheet.select(
        F.lit("2-HIGH").alias("import_id"), "row_index",
        S.payload([*X.SHEET_MAPPING, "Notes"]).alias("raw_payload"),
    )
    imports = X.conform(X.import_history(spark, sf_dir), R_IMPORTS)
    _, updated, preview = M.confirm_mapping(
        creators, imports, "2-HIGH", X.SHEET_MAPPING, X.now()
    )
    first = preview.select(
        F.lit("preview").alias("part"), F.col("row_index").cast("string").alias("key"),
        F.concat_ws("/", F.coalesce("n_full_name", F.lit("-")),
                    F.coalesce("n_email", F.lit("-"))).alias("value"),
    )
    state = updated.select(
        F.lit("import").alias("part"), F.col("id").alias("key"),
        F.concat_ws("/", "status", F.col("row_count").cast("string")).alias("value"),
    )
    return first.unionByName(state)


@query
def validate_rows(spark, sf_dir):
    """Quarantined records with the rules they break."""
    rows = X.resolved_creators(spark, sf_dir).withColumns(
        {
            "review_status": F.when(F.col("row_index") % 31 == 0, "maybe")
            .otherwise(F.col("review_status")),
            "confidence_score": F.when(F.col("row_index") % 37 == 0, 101)
            .otherwise(F.col("confidence_score")),
            "import_id": F.when(F.col("row_index") % 41 != 0, F.col("import_id")),
        }
    )
    _, bad = validate(rows, RULES["creators"])
    return bad.select("row_index", joined("violations").alias("violations"))


# --- text and keys --------------------------------------------------------------------


@query
def normalize(spark, sf_dir):
    return normalized(spark, sf_dir).select(
        "id", "n_full_name", "n_username", "n_email", "n_profile_url", "n_platform"
    )


@query
def clean_names(spark, sf_dir):
    """Name clean-up on part, brand and customer texts."""
    parts = X.read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        F.concat_ws(" ", F.lit("Dr."), "p_name", F.lit("--,"), F.upper("p_type"),
                    F.lit("of 3 | tag")).alias("text"),
    )
    return T.with_clean_names(parts, {"name": "text"}).select("k", "name")


@query
def descriptor_words(spark, sf_dir):
    """Descriptor tests on the words of all documents."""
    words = X.read(spark, sf_dir, "documents").select(
        "doc_id", F.explode(T.words(F.col("text"))).alias("word")
    )
    return words.groupBy("doc_id").agg(
        F.count("*").alias("words"),
        F.count_if(T.is_descriptor_word(F.col("word"))).alias("descriptors"),
        F.count_if(T.contains_descriptor(F.col("word"))).alias("containing"),
    )


@query
def handle_tokens(spark, sf_dir):
    return normalized(spark, sf_dir).where("n_username IS NOT NULL").select(
        "id", joined(T.tokens(F.col("n_username"))).alias("tokens"),
        T.strip_descriptor_suffix(F.col("n_username")).alias("without_suffix"),
    )


@query
def canonical_keys(spark, sf_dir):
    return C.lookup_keys(normalized(spark, sf_dir), "id").drop("key_pos")


@query
def platform(spark, sf_dir):
    """Platform and canonical URL of records and of the web pages."""
    urls = X.raw_import(spark, sf_dir).where("raw_profile_url IS NOT NULL").select(
        F.col("row_index").alias("k"), F.col("raw_profile_url").alias("url")
    ).unionByName(X.read(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("k"), "url"))
    return urls.select(
        "k", canonical_profile_url(F.col("url")).alias("canonical"),
        platform_of(F.col("url")).alias("platform"),
    )


# --- candidates ------------------------------------------------------------------------


def candidate_columns(column: str) -> list[Column]:
    c = F.col(column)
    return [
        c["source"].alias("source"), c["first_name"].alias("first_name"),
        c["last_name"].alias("last_name"), c["confidence"].cast("bigint").alias("confidence"),
        flag(c["ambiguous"]).alias("ambiguous"),
        flag(c["handle_fallback"]).alias("handle_fallback"),
        flag(c["business_like"]).alias("business_like"),
    ]


@query
def cand_full_name(spark, sf_dir):
    df = E.with_full_name_candidate(normalized(spark, sf_dir))
    dropped = F.get_json_object(F.col("cand_full_name")["meta"], "$.droppedMiddleTokens[0]")
    return df.where("cand_full_name IS NOT NULL").select(
        "id", *candidate_columns("cand_full_name"), dropped.alias("dropped")
    )


@query
def cand_email(spark, sf_dir):
    df = E.with_email_candidate(normalized(spark, sf_dir), X.dictionary(spark, sf_dir))
    order = F.get_json_object(F.col("cand_email")["meta"], "$.orderDetection")
    return df.where("cand_email IS NOT NULL").select(
        "id", *candidate_columns("cand_email"), order.alias("name_order")
    )


@query
def cand_username(spark, sf_dir):
    df = E.with_username_candidate(normalized(spark, sf_dir), X.dictionary(spark, sf_dir))
    return df.where("cand_username IS NOT NULL").select(
        "id", *candidate_columns("cand_username")
    )


@query
def prefix_split(spark, sf_dir):
    """Longest known first name in front of run-on handles."""
    rows = X.raw_import(spark, sf_dir).select(
        F.col("row_index").cast("string").alias("id"), F.concat("f", "l").alias("token")
    )
    return X.dictionary(spark, sf_dir).longest_prefix(rows, "token", "cut", "id").select(
        "id", "token", number("cut").alias("cut")
    )


@query
def doc_emails(spark, sf_dir):
    """E-mail candidates from addresses found anywhere in the documents."""
    found = X.read(spark, sf_dir, "documents").select(
        "doc_id",
        F.explode(
            F.regexp_extract_all(
                "text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)
            )
        ).alias("raw_email"),
    )
    rows = found.select("doc_id", F.lower("raw_email").alias("n_email")).distinct()
    rows = rows.withColumn("id", F.concat_ws("|", F.col("doc_id").cast("string"), "n_email"))
    df = E.with_email_candidate(rows, X.dictionary(spark, sf_dir))
    return df.where("cand_email IS NOT NULL").select(
        "doc_id", "n_email", *candidate_columns("cand_email")
    )


@query
def page_fields(spark, sf_dir):
    """Fields of all web pages, with the usability test of the fetcher."""
    pages = P.page_fields(X.read(spark, sf_dir, "pages"))
    return pages.select(
        "page_id", "title", "og_title", "og_description",
        flag(F.length("html") >= K.MIN_USABLE_HTML).alias("usable"),
    )


@query
def usable_profile_pages(spark, sf_dir):
    return static_and_browser_pages(spark, sf_dir).select(
        "url", "fetched_via", F.length("html").cast("bigint").alias("html_length")
    )


@query
def page_candidates(spark, sf_dir):
    """Scrape outcome of every record with a profile URL."""
    records = normalized(spark, sf_dir).where("n_profile_url IS NOT NULL")
    df = P.attach_pages(records, static_and_browser_pages(spark, sf_dir))
    df = P.with_profile_candidate(df, X.dictionary(spark, sf_dir))
    c = F.col("cand_profile")
    return df.select(
        "id", "scrape_platform", "scrape_error", "fetched_via",
        c["source"].alias("source"), c["first_name"].alias("first_name"),
        c["last_name"].alias("last_name"), c["display_name"].alias("display_name"),
        c["social_handle"].alias("handle"),
        c["confidence"].cast("string").alias("confidence"),
        c["business_like"].cast("int").cast("string").alias("business_like"),
        c["handle_fallback"].cast("int").cast("string").alias("handle_fallback"),
        F.get_json_object("raw_snapshot", "$.ogTitle").alias("snapshot_title"),
    )


# --- text beyond ASCII --------------------------------------------------------------------


@query
def folded_text(spark, sf_dir):
    """Accents and full-width letters of whole documents, folded."""
    docs = X.read(spark, sf_dir, "documents")
    wide = F.translate("text", "aeZ", "ａｅＺ")
    return docs.select(
        "doc_id", F.md5(T.fold_unicode(F.col("text"))).alias("folded"),
        F.md5(T.fold_unicode(wide)).alias("folded_wide"),
    )


@query
def emoji_to_space(spark, sf_dir):
    """Pictographs after every full stop of whole documents."""
    docs = X.read(spark, sf_dir, "documents")
    signs = F.array(*[F.lit(c) for c in X.PICTOGRAPHS])
    sign = F.element_at(signs, (F.col("doc_id") % len(X.PICTOGRAPHS) + 1).cast("int"))
    signed = F.replace("text", F.lit("."), F.concat(F.lit("."), sign))
    return docs.select("doc_id", F.md5(T.strip_emoji(signed)).alias("plain"))


@query
def title_cased(spark, sf_dir):
    """Names of parts, in one case, with blanks, apostrophes or hyphens."""
    part = X.read(spark, sf_dir, "part")
    joint = F.element_at(
        F.array(F.lit(" "), F.lit("'"), F.lit("-")), (F.col("p_partkey") % 3 + 1).cast("int")
    )
    name = F.replace("p_name", F.lit(" "), joint)
    return part.select(
        "p_partkey", T.title_case_if_shouty(name).alias("lower"),
        T.title_case_if_shouty(F.upper(name)).alias("upper"),
        T.title_case_if_shouty(F.concat(F.lit("Mc"), name)).alias("mixed"),
    )


@query
def snake_cased(spark, sf_dir):
    part = X.read(spark, sf_dir, "part")
    camel = F.concat(F.lit("raw"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return part.select("p_partkey", T.snake_case(camel).alias("snake"))


@query
def event_dates(spark, sf_dir):
    """Epoch milliseconds of all events as text, in two time zones."""
    events = X.read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", T.format_epoch_ms(ms).alias("utc"),
        T.format_epoch_ms(ms, "Asia/Tokyo").alias("tokyo"),
    )


# --- scoring ------------------------------------------------------------------------------


def scored(spark, sf_dir, with_pages: bool = True) -> DataFrame:
    pages = static_and_browser_pages(spark, sf_dir, True) if with_pages else None
    df = gather_candidates(
        normalized(spark, sf_dir, with_pages), X.dictionary(spark, sf_dir), pages
    )
    return fill_from_input(score(df, CANDIDATE_COLUMNS))


def resolved_columns() -> list[Column]:
    return [F.col(f"resolved_{f}").alias(f) for f in K.OVERRIDABLE_FIELDS.values()]


@query
def score_winner(spark, sf_dir):
    """Winner by tiers over all four evidence sources."""
    return scored(spark, sf_dir).select(
        "id", "w_first_name", "w_last_name", "w_display_name", "w_confidence_source",
        F.col("w_confidence_score").cast("bigint").alias("w_confidence_score"),
        "w_processing_status", flag("w_needs_review").alias("w_needs_review"),
    )


@query
def score_array(spark, sf_dir):
    """The same winner taken from an array of candidates."""
    df = gather_candidates(normalized(spark, sf_dir), X.dictionary(spark, sf_dir))
    df = score(df.withColumn("candidates", E.collect_candidates(*CANDIDATE_COLUMNS)))
    return df.select(
        "id", F.size("candidates").cast("bigint").alias("candidates"), "w_first_name",
        "w_last_name", "w_confidence_source", "w_processing_status",
    )


@query
def resolved(spark, sf_dir):
    return scored(spark, sf_dir).select("id", *resolved_columns())


# --- cache and enrichment --------------------------------------------------------------


@query
def cache_lookup(spark, sf_dir):
    _, keys = X.identity_cache(spark, sf_dir)
    rows = C.lookup(normalize_records(X.creators(spark, sf_dir)), keys)
    ids = F.coalesce(F.array_sort("matched_ids"), F.array().cast("array<string>"))
    return rows.select("id", "cache_status", joined(ids).alias("identities"))


@query
def cache_identities(spark, sf_dir):
    """Every key hit with the identity behind it."""
    cache, keys = X.identity_cache(spark, sf_dir)
    hits = C.lookup_keys(normalize_records(X.creators(spark, sf_dir)), "id").join(
        keys, C.KEY
    )
    cached = C.attach_identities(hits, X.conform(cache, R_CACHE), "identity_cache_id")
    return cached.select(
        "id", "key_type", "identity_cache_id", "c_first_name", "c_last_name", "c_email"
    )


@X.once
def enriched(spark, sf_dir, with_cache=True, with_pages=True, mode="snapshot") -> EnrichResult:
    cache, keys = X.identity_cache(spark, sf_dir, True) if with_cache else (None, None)
    rows = X.creators(spark, sf_dir, True)
    pages = static_and_browser_pages(spark, sf_dir, True) if with_pages else None
    return enrich(
        rows, X.dictionary(spark, sf_dir),
        None if cache is None else X.conform(cache, R_CACHE), keys, pages, mode, now=X.now(),
    )


def enriched_columns() -> list[Column]:
    return [
        F.col("id"), *resolved_columns(),
        F.col("confidence_score").cast("bigint").alias("confidence_score"),
        F.col("confidence_source"), F.col("processing_status"),
        flag("needs_review").alias("needs_review"), F.col("identity_cache_id"),
    ]


@query
def enrich_snapshot(spark, sf_dir):
    """All imports against an empty cache, no pages."""
    return enriched(spark, sf_dir, False, False).creators.select(*enriched_columns())


@query
def enrich_with_cache(spark, sf_dir):
    """All imports against a cache filled from one of them, with pages."""
    return enriched(spark, sf_dir).creators.select(*enriched_columns())


@query
def cache_conflict(spark, sf_dir):
    """Records whose keys point at different identities always need review."""
    result = enriched(spark, sf_dir)
    conflicts = result.logs.where("step = 'cache_lookup' AND status = 'failed'")
    return result.creators.join(
        conflicts.select(F.col("creator_id").alias("id")), "id"
    ).select("id", "processing_status", flag("needs_review").alias("needs_review"))


@query
def cache_upsert(spark, sf_dir):
    """Keys a run adds to the cache, with their owner."""
    return enriched(spark, sf_dir).new_keys.select("key_type", "key_value", "identity_cache_id")


@query
def cache_create(spark, sf_dir):
    return enriched(spark, sf_dir).new_identities.select(
        "id", "first_name", "last_name", "email", "social_handle", "profile_url",
        F.col("confidence_score").cast("bigint").alias("confidence_score"),
        "confidence_source", flag("verified").alias("verified"),
    )


@query
def cache_add_keys(spark, sf_dir):
    """Insert-or-ignore of the keys of all records into the stored keys."""
    _, keys = X.identity_cache(spark, sf_dir)
    more = C.lookup_keys(normalized(spark, sf_dir), "id", "row_index").select(
        "row_index", *C.KEY, F.concat(F.lit("new-"), "id").alias("identity_cache_id"),
        X.now().alias("created_at"),
    )
    return C.add_keys(keys, more, ["row_index"]).select(*C.KEY, "identity_cache_id")


@query
def logs_fanout(spark, sf_dir):
    logs = enriched(spark, sf_dir).logs
    return logs.select(
        "creator_id", F.col("seq").cast("bigint").alias("seq"), "step", "status",
        F.coalesce(
            F.get_json_object("detail", "$.identityCacheId"),
            F.get_json_object("detail", "$.confidenceScore"),
            F.get_json_object("detail", "$.error"),
        ).alias("detail"),
    )


@query
def profile_snapshots(spark, sf_dir):
    return enriched(spark, sf_dir, False).snapshots.select(
        "creator_id", "platform", "fetched_via",
        F.get_json_object("raw_snapshot", "$.ogTitle").alias("og_title"),
        F.get_json_object("raw_snapshot", "$.bio").alias("bio"),
    )


@query
def run_summary(spark, sf_dir):
    """processed / failed, with a few records that cannot be processed."""
    rows = X.creators(spark, sf_dir).withColumn(
        "row_index", F.when(F.col("row_index") % 500 != 0, F.col("row_index"))
    )
    result = enrich(rows, X.dictionary(spark, sf_dir), mode="snapshot", now=X.now())
    return result.summary()


@query
def import_stats(spark, sf_dir):
    return R.import_stats(enriched(spark, sf_dir).creators)


@query
def enrich_sequential(spark, sf_dir):
    """All imports, each record seeing the keys of all earlier ones."""
    return enriched(spark, sf_dir, False, True, "sequential").creators.select(
        *enriched_columns()
    )


@query
def sequential_snapshots(spark, sf_dir):
    """Page snapshots of the records that no earlier record answered."""
    return enriched(spark, sf_dir, False, True, "sequential").snapshots.select(
        "creator_id", "platform", "fetched_via",
        F.get_json_object("raw_snapshot", "$.ogTitle").alias("og_title"),
        F.get_json_object("raw_snapshot", "$.bio").alias("bio"),
    )


@query
def sequential_logs(spark, sf_dir):
    """How many records left how many log entries, by outcome of the cache lookup."""
    status = F.max(F.when(F.col("step") == "cache_lookup", F.col("status")))
    per_record = (
        enriched(spark, sf_dir, False, True, "sequential").logs.groupBy("creator_id")
        .agg(F.count("*").alias("entries"), status.alias("status"))
    )
    outcome = (
        F.when(F.col("status") == "success", "hit").when(F.col("status") == "failed", "conflict")
        .otherwise("miss")
    )
    return per_record.groupBy(outcome.alias("cache_status"), "entries").agg(
        F.count("*").alias("records")
    )


@query
def enrich_stream(spark, sf_dir):
    """All imports in four micro-batches that share keys; the last one is delivered twice."""
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = X.creators(spark, sf_dir, True)
    for batch in range(X.STREAM_BATCHES):
        # four files, so four files a trigger are one batch
        rows.where(F.col("row_index") % X.STREAM_BATCHES == batch).repartition(4).write.mode(
            "append"
        ).parquet(f"{folder}/landing")
    stream = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4)
        .parquet(f"{folder}/landing")
    )
    job = IncrementalEnrichment(
        spark, f"{folder}/state", X.dictionary(spark, sf_dir), buckets=8
    )
    job.start(stream, f"{folder}/progress", availableNow=True).awaitTermination()
    last = X.STREAM_BATCHES - 1
    job.run_batch(rows.where(F.col("row_index") % X.STREAM_BATCHES == last), last)
    return job.table("creators").select(*enriched_columns(), "batch_id")


# --- duplicates and reports --------------------------------------------------------------


@query
def duplicate_groups(spark, sf_dir):
    return D.duplicate_groups(X.resolved_creators(spark, sf_dir)).select(
        "import_id", "key_type", L.key_type_label(F.col("key_type")).alias("matched_on"),
        "key_value", "size", "first_creator_id",
    )


@query
def duplicates(spark, sf_dir):
    return D.duplicate_members(X.resolved_creators(spark, sf_dir)).select(
        "import_id", "key_type", "key_value", "row_index", "creator_id", "first_name",
        "last_name", "size",
    )


@query
def confidence_buckets(spark, sf_dir):
    rows = X.resolved_creators(spark, sf_dir)
    kept = L.filter_buckets(rows, ["high", "low"])
    return kept.groupBy(L.confidence_bucket(F.col("confidence_score")).alias("bucket")).agg(
        F.count("*").alias("rows")
    )


@query
def shown_of_total(spark, sf_dir):
    return R.shown_of_total(X.resolved_creators(spark, sf_dir), ["medium"])


@query
def review_list(spark, sf_dir):
    return R.review_list(X.resolved_creators(spark, sf_dir)).select(
        "id", "name", number("confidence_score").alias("confidence_score"), "bucket",
        "evidence", "status", flag("needs_review").alias("needs_review"), "review_status",
        "duplicate_of_creator_id",
    )


@query
def creator_detail(spark, sf_dir):
    detail = R.creator_detail(X.resolved_creators(spark, sf_dir))
    return detail.withColumns(
        {
            "confidence_score": number("confidence_score"),
            "needs_review": flag("needs_review"),
            "created_at": moment("created_at"), "updated_at": moment("updated_at"),
        }
    )


@query
def point_lookup(spark, sf_dir):
    asked = X.derived(spark, sf_dir, X.UNMERGE_REQUESTS).select(F.col("creator_id").alias("id"))
    return R.by_ids(X.resolved_creators(spark, sf_dir), asked).select("id", "import_id")


@query
def import_rows(spark, sf_dir):
    """One import in file order."""
    return R.by_import(X.resolved_creators(spark, sf_dir), "3-MEDIUM").select("id", "row_index")


@query
def first_rows(spark, sf_dir):
    return R.preview(X.resolved_creators(spark, sf_dir)).select("id", "row_index")


@query
def creator_timeline(spark, sf_dir):
    logs = X.processing_logs(spark, sf_dir)
    snapshots = logs.where("step = 'view'").select(
        "creator_id", F.col("created_at").alias("fetched_at"), F.lit("generic").alias("platform"),
        F.lit("static").alias("fetched_via"), F.col("detail").alias("raw_snapshot"),
    )
    return R.creator_timeline(logs, snapshots).select(
        "creator_id", "section", moment("at").alias("at"), F.col("seq").cast("bigint").alias("seq"),
        "label", "status", F.get_json_object("detail", "$.k").alias("k"),
    )


@query
def latest_log(spark, sf_dir):
    latest = R.latest_log(X.processing_logs(spark, sf_dir), "purchase")
    return latest.select("creator_id", "id", moment("created_at").alias("created_at"))


@query
def latest_per_step(spark, sf_dir):
    latest = R.latest_per_step(X.processing_logs(spark, sf_dir))
    return latest.select(
        "creator_id", "step", moment("created_at").alias("created_at"), "status", "entries"
    )


def run_logs(spark, sf_dir) -> DataFrame:
    """The event stream read as run logs: a purchase finishes a record."""
    step = F.when(F.col("step") == "purchase", "final_selection").otherwise(F.col("step"))
    return X.processing_logs(spark, sf_dir).withColumn("step", step)


@query
def job_progress(spark, sf_dir):
    progress = R.job_progress(X.users(spark, sf_dir), run_logs(spark, sf_dir))
    return progress.select(
        "import_id", "total_rows", "processed_rows", "attempts", "last_processed_row_index",
        "status", moment("started_at").alias("started_at"),
        moment("completed_at").alias("completed_at"),
    )


@query
def resume_rows(spark, sf_dir):
    done = run_logs(spark, sf_dir).where("created_at < '2024-01-05'")
    return R.resume_rows(X.users(spark, sf_dir), done).select("id", "import_id", "row_index")


@query
def next_unfinished(spark, sf_dir):
    done = run_logs(spark, sf_dir).where("created_at < '2024-01-05'")
    return R.next_unfinished(X.users(spark, sf_dir), done)


@query
def next_pending(spark, sf_dir):
    return R.next_pending(X.derived(spark, sf_dir, X.JOB_ITEMS)).select(
        "job_id", "creator_id", "row_index", "status",
        F.col("attempts").cast("bigint").alias("attempts"),
    )


@query
def top_imports(spark, sf_dir):
    imports = X.conform(X.import_history(spark, sf_dir), R_IMPORTS)
    return R.import_list(imports, 4).select(
        "id", "file_name", "row_count", "status", "status_label", "next_action",
        moment("created_at").alias("created_at"),
    )


@query
def top_exports(spark, sf_dir):
    return R.export_list(X.export_history(spark, sf_dir)).select(
        "id", "import_id", "export_type", "file_name", "row_count",
        moment("created_at").alias("created_at"),
    )


@query
def import_status(spark, sf_dir):
    imports = X.conform(X.import_history(spark, sf_dir), R_IMPORTS)
    updates = imports.where("status <> 'uploaded'").select(
        "id",
        F.when(F.col("status") == "mapped", "processing").otherwise("completed").alias("status"),
        F.when(F.col("status") != "mapped", F.concat(F.lit("job-"), "id")).alias("job_id"),
    )
    return R.update_import_status(imports, updates, X.now()).select(
        "id", "status", "job_id", moment("completed_at").alias("completed_at")
    )


# --- review -----------------------------------------------------------------------------


@query
def approve_ignore(spark, sf_dir):
    actions = X.review_actions(spark, sf_dir).where("action <> 'override'").select(
        "seq", F.col("row_index").cast("string").alias("creator_id"), "action"
    )
    second = actions.where("seq % 5 = 0").select(
        (F.col("seq") + 1_000_000_000).alias("seq"), "creator_id", F.lit("ignore").alias("action")
    )
    result = V.apply_review(
        X.resolved_creators(spark, sf_dir), actions.unionByName(second), X.now(), "review"
    )
    logs = result.logs.groupBy("creator_id").agg(F.count("*").alias("logs"))
    rejects = result.rejects.groupBy("creator_id").agg(F.count("*").alias("rejects"))
    counts = logs.join(rejects, "creator_id", "full").withColumnRenamed("creator_id", "id")
    return result.creators.join(counts, "id", "left").select(
        "id", "review_status", F.coalesce("logs", F.lit(0)).alias("logs"),
        F.coalesce("rejects", F.lit(0)).alias("rejects"),
    )


@query
def bulk_review(spark, sf_dir):
    """Everything that waits for review approved at once; a few actions without a place."""
    rows = X.resolved_creators(spark, sf_dir)
    chosen = V.bulk_actions(rows, F.col("needs_review"), "approve", 3_000_000_000)
    odd = X.review_actions(spark, sf_dir).where("action = 'ignore'").select(
        F.when(F.col("seq") % 2 == 0, F.lit(7)).cast("bigint").alias("seq"),
        F.col("row_index").cast("string").alias("creator_id"), "action",
    )
    result = V.apply_review(rows, chosen.unionByName(odd), X.now(), "bulk")
    logs = result.logs.groupBy(F.col("creator_id").alias("id")).agg(
        F.count("*").alias("logs"), F.countDistinct("id").alias("log_ids")
    )
    bad = result.rejects.groupBy(F.col("creator_id").alias("id")).agg(
        F.max("reject_reason").alias("reject_reason")
    )
    return result.creators.join(logs, "id", "left").join(bad, "id", "left").select(
        "id", "review_status", F.coalesce("logs", F.lit(0)).alias("logs"),
        F.coalesce("log_ids", F.lit(0)).alias("log_ids"), "reject_reason",
    )


@X.once
def overridden(spark, sf_dir) -> V.ReviewResult:
    cache = spark.sql(
        "SELECT DISTINCT identity_cache_id AS id, 'old' AS first_name, 'old@x' AS email, "
        "'1.0.0' AS pipeline_version, false AS verified FROM {c} "
        "WHERE identity_cache_id IS NOT NULL",
        c=X.resolved_creators(spark, sf_dir),
    )
    _, keys = X.identity_cache(spark, sf_dir)
    return V.apply_overrides(
        X.resolved_creators(spark, sf_dir), X.conform(cache, R_CACHE),
        X.conform(keys, R_KEYS), X.overrides(spark, sf_dir), X.now(), "override",
    )


@query
def override(spark, sf_dir):
    rows = overridden(spark, sf_dir).creators.where("confidence_source = 'manual_override'")
    return rows.select(
        "id", *resolved_columns(),
        F.col("confidence_score").cast("bigint").alias("confidence_score"),
        "processing_status", flag("needs_review").alias("needs_review"), "review_status",
        "identity_cache_id",
    )


@query
def override_audit(spark, sf_dir):
    return overridden(spark, sf_dir).manual_overrides.select(
        "identity_cache_id", "field", "old_value", "new_value", "reason", "created_by"
    )


@query
def override_cache(spark, sf_dir):
    cache = overridden(spark, sf_dir).identity_cache
    return cache.select(
        "id", "first_name", "email", "social_handle",
        number("confidence_score").alias("confidence_score"), "confidence_source",
        flag("verified").alias("verified"),
    )


@query
def override_keys(spark, sf_dir):
    return overridden(spark, sf_dir).identity_cache_keys.select(*C.KEY, "identity_cache_id")


@query
def override_rejects(spark, sf_dir):
    return overridden(spark, sf_dir).rejects.select("seq", "creator_id", "reject_reason")


@X.once
def merged(spark, sf_dir) -> V.ReviewResult:
    return V.merge_duplicates(
        X.resolved_creators(spark, sf_dir), X.derived(spark, sf_dir, X.MERGE_PAIRS), X.now(), "merge"
    )


def state_columns() -> list[Column]:
    return [
        F.col("id"), *resolved_columns(), number("confidence_score").alias("confidence_score"),
        F.col("confidence_source"), F.col("processing_status"),
        flag("needs_review").alias("needs_review"), F.col("review_status"),
        F.col("identity_cache_id"), F.col("duplicate_of_creator_id"),
    ]


@query
def merge(spark, sf_dir):
    return merged(spark, sf_dir).creators.select(*state_columns())


@query
def merge_chains(spark, sf_dir):
    """Records merged into records that were merged before them, some fifty times over."""
    pairs = X.derived(spark, sf_dir, X.MERGE_CHAINS)
    result = V.merge_duplicates(X.resolved_creators(spark, sf_dir), pairs, X.now(), "chains")
    return result.creators.select(*state_columns())


@query
def merge_logs(spark, sf_dir):
    logs = merged(spark, sf_dir).logs
    detail = {
        "target": "$.targetCreatorId", "first_name": "$.preMergeSnapshot.resolvedFirstName",
        "score": "$.preMergeSnapshot.confidenceScore",
        "review_status": "$.preMergeSnapshot.reviewStatus",
    }
    return logs.select(
        "creator_id", "step",
        *[F.get_json_object("detail", path).alias(name) for name, path in detail.items()],
    )


@query
def merge_rejects(spark, sf_dir):
    return merged(spark, sf_dir).rejects.select("seq", "source_id", "target_id", "reject_reason")


@X.once
def unmerged(spark, sf_dir) -> V.ReviewResult:
    before = merged(spark, sf_dir)
    return V.unmerge(
        before.creators, before.logs, X.derived(spark, sf_dir, X.UNMERGE_REQUESTS), X.now(), "unmerge"
    )


@query
def unmerge(spark, sf_dir):
    return unmerged(spark, sf_dir).creators.select(*state_columns())


@query
def unmerge_rejects(spark, sf_dir):
    return unmerged(spark, sf_dir).rejects.select("seq", "creator_id", "reject_reason")


# --- export and integrity ------------------------------------------------------------------


@query
def export_quick(spark, sf_dir):
    return O.export_rows(X.resolved_creators(spark, sf_dir), "quick", 0)


@query
def export_full(spark, sf_dir):
    rows = O.export_rows(X.resolved_creators(spark, sf_dir), "full", 1_700_000_000_000)
    return rows.withColumns(
        {"confidenceScore": number("confidenceScore"), "needsReview": flag("needsReview")}
    )


@query
def export_csv(spark, sf_dir):
    """The quick list of one import written as CSV and read back, with its history row."""
    folder = f"{scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    history = O.write_export(
        X.resolved_creators(spark, sf_dir), "2-HIGH", "quick", folder, 1_700_000_000_000
    )
    name = O.export_name("quick", "2-HIGH", 1_700_000_000_000)
    rows = S.read_csv(spark, f"{folder}/{name}").named()
    return rows.select(
        F.lit("row").alias("part"), F.col("firstName").alias("a"), F.col("email").alias("b"),
        F.col("socialHandle").alias("c"),
    ).unionByName(
        history.select(
            F.lit("history").alias("part"), F.col("file_name").alias("a"),
            F.col("export_type").alias("b"), F.col("row_count").cast("string").alias("c"),
        )
    )


@query
def export_one_file(spark, sf_dir):
    """The same list as one file: its rows with their places in the file."""
    folder = f"{scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    sent_at = 1_700_000_000_000
    creators = X.resolved_creators(spark, sf_dir)
    O.write_export(creators, "2-HIGH", "quick", folder, sent_at, single_file=True)
    path = f"{folder}/{O.export_name('quick', '2-HIGH', sent_at)}"
    rows = S.ingest_csv(spark, path, "back", X.now()).creators

    def cell(name: str) -> Column:
        return F.coalesce(F.get_json_object("raw_payload", f"$.{name}"), F.lit(""))

    return rows.select(
        F.col("row_index").cast("bigint").alias("place"), cell("firstName").alias("a"),
        cell("email").alias("b"), cell("socialHandle").alias("c"),
    )


@X.once
def after_delete(spark, sf_dir) -> I.Tables:
    creators = X.resolved_creators(spark, sf_dir)
    logs = creators.select(
        F.col("id").alias("creator_id"), "row_index", F.lit("normalized").alias("step")
    )
    tables = {
        "import_history": X.import_history(spark, sf_dir), "creators": creators,
        "processing_logs": logs, "export_history": X.export_history(spark, sf_dir),
    }
    gone = literal_table(spark, [("2-HIGH",), ("5-LOW",)], ["id"])
    return I.delete_imports(tables, gone)


@query
def cascade_delete(spark, sf_dir):
    """Rows left per table after two imports are deleted."""
    tables = after_delete(spark, sf_dir)
    return X.union(
        [
            tables["import_history"].select(F.lit("imports").alias("t"), F.col("id")),
            tables["creators"].select(F.lit("creators").alias("t"), F.col("id")),
            tables["processing_logs"].select(
                F.lit("logs").alias("t"), F.col("creator_id").alias("id")
            ),
        ]
    )


@query
def set_null(spark, sf_dir):
    """Links that pointed into the deleted imports are cleared."""
    tables = after_delete(spark, sf_dir)
    return tables["creators"].select(
        F.lit("creators").alias("t"), "id", F.col("duplicate_of_creator_id").alias("link")
    ).unionByName(
        tables["export_history"].select(
            F.lit("exports").alias("t"), "id", F.col("import_id").alias("link")
        )
    )


@query
def delete_identities(spark, sf_dir):
    creators = X.resolved_creators(spark, sf_dir)
    cache, keys = X.identity_cache(spark, sf_dir)
    links = creators.where("identity_cache_id IS NOT NULL").select(
        F.col("identity_cache_id").alias("id")
    ).distinct()
    gone = links.where("id LIKE '%7%'").unionByName(cache.where("id LIKE '%blue%'").select("id"))
    tables = I.delete_identities(
        {"identity_cache": cache, "identity_cache_keys": keys, "creators": creators}, gone
    )
    return X.union(
        [
            tables["identity_cache"].select(
                F.lit("cache").alias("t"), F.col("id"), F.lit("").alias("link")
            ),
            tables["identity_cache_keys"].select(
                F.lit("keys").alias("t"), F.concat_ws(":", *C.KEY).alias("id"),
                F.col("identity_cache_id").alias("link"),
            ),
            tables["creators"].select(
                F.lit("creators").alias("t"), "id", F.col("identity_cache_id").alias("link")
            ),
        ]
    )

