"""Inputs of the registered queries, derived from the given tables.

Each fixture is one SQL text with {table} slots. Spark fills them with DataFrames,
the oracle with table names, so both sides start from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from personae.operators.dictionary import NameDictionary
from personae.operators.scale import materialize
from personae.schema import CREATORS, conform, new_creators

# one record per order; the person's names are the two words of a part name
RAW_IMPORT = """
SELECT import_id, k AS row_index,
  CASE WHEN k % 7 <> 0 THEN NULL
       WHEN k % 3 = 0 THEN upper(f) || ' ' || upper(l) || ' | UGC Creator'
       WHEN k % 3 = 1 THEN 'Dr. ' || upper(substr(f, 1, 1)) || substr(f, 2) || ' Q '
                           || upper(substr(l, 1, 1)) || substr(l, 2)
       ELSE '  ' || f || '   ' || l || ' -- CEO' END AS raw_full_name,
  CASE WHEN k % 5 NOT IN (1, 2) THEN NULL
       WHEN k % 13 = 0 THEN '@' || f || 'pilates'
       WHEN k % 17 = 0 THEN 'mrs_' || f || '_'
       WHEN k % 19 = 0 THEN l || '.' || l
       WHEN k % 4 = 0 THEN '@' || f || l
       WHEN k % 4 = 1 THEN '@' || f || '.' || l || CAST(ck % 50 AS STRING)
       WHEN k % 4 = 2 THEN l || '_' || f || CAST(ck % 50 AS STRING)
       ELSE f || l || 'pilates' END AS raw_username,
  CASE WHEN k % 3 = 1 THEN NULL
       WHEN k % 13 = 0 THEN l || '.' || l || '@example.com'
       WHEN k % 4 = 0 THEN f || '.' || l || CAST(ck % 97 AS STRING) || '@Example.com '
       WHEN k % 4 = 1 THEN l || '.' || f || CAST(ck % 97 AS STRING) || '@example.com'
       WHEN k % 4 = 2 THEN f || CAST(ck AS STRING) || '@example.com'
       ELSE f || '.x.' || l || CAST(ck % 97 AS STRING) || '@example.com' END AS raw_email,
  CASE WHEN k % 11 <> 0 THEN NULL
       ELSE 'https://www.' || CASE k % 4 WHEN 0 THEN 'Instagram.com/'
              WHEN 1 THEN 'tiktok.com/@' WHEN 2 THEN 'facebook.com/' ELSE 'linktr.ee/' END
            || CASE WHEN k % 4 = 2 AND ck % 3 = 0 THEN 'profile.php?id=' || CAST(ck % 200 AS STRING)
                    ELSE f || l || CAST(ck % 200 AS STRING) || '/' END END AS raw_profile_url,
  CAST(NULL AS STRING) AS raw_platform,
  f, l
FROM (
  SELECT o_orderpriority AS import_id, o_orderkey AS k, o_custkey AS ck,
         split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l
  FROM {orders} JOIN {part} ON p_partkey = o_custkey
) AS source
"""

FIRST_NAMES = "SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM {part}"

# one page per distinct profile URL; a third is long enough to be a static page,
# a third of the short ones has a browser copy, the rest has no usable page;
# every other URL has a long page without any name under another spelling
PROFILE_PAGES = """
SELECT replace(url, 'https://www.', 'http://') AS url, k,
  '<html><head></head><body>' || repeat('<p>empty</p>', 200) || '</body></html>' AS html,
  'static' AS copy
FROM (SELECT raw_profile_url AS url, min(row_index) AS k
      FROM {raw_import} WHERE raw_profile_url IS NOT NULL GROUP BY raw_profile_url) AS spelled
WHERE k % 2 = 0
UNION ALL
SELECT url, k,
  '<html><head>'
  || CASE k % 6
       WHEN 0 THEN '<meta property="og:title" content="' || cf || ' ' || cl || ' (@' || f || l || ')">'
       WHEN 1 THEN '<meta property="og:title" content="' || CASE
              WHEN url LIKE '%Instagram%' THEN 'Instagram' WHEN url LIKE '%tiktok%' THEN 'TikTok'
              WHEN url LIKE '%facebook%' THEN 'Facebook' ELSE 'Linktree' END || '">'
       WHEN 2 THEN '<meta content="' || cf || ' Hairstylist (@' || f || l || ')" property="og:title">'
       WHEN 3 THEN '<meta property="og:title" content="' || cf || ' ' || cl || ' | Coach (@' || f || l || ')">'
       WHEN 4 THEN '<title>Log in</title>'
       ELSE '' END
  || '<meta property="og:description" content="about ' || f || '"></head><body>'
  || CASE WHEN p = 0 THEN repeat('<p>words</p>', 200) ELSE '' END
  || '</body></html>' AS html,
  CASE p WHEN 0 THEN 'static' WHEN 1 THEN 'browser' ELSE 'none' END AS copy
FROM (
  SELECT raw_profile_url AS url, min(row_index) AS k, min(f) AS f, min(l) AS l,
         min(upper(substr(f, 1, 1)) || substr(f, 2)) AS cf,
         min(upper(substr(l, 1, 1)) || substr(l, 2)) AS cl,
         CAST(floor(min(row_index) / 66.0) AS BIGINT) % 3 AS p
  FROM {raw_import} WHERE raw_profile_url IS NOT NULL GROUP BY raw_profile_url
) AS urls
"""

# cache before the run: what the rows of one import left behind, with every tenth
# username handed to another identity so that conflicts occur
IDENTITY_CACHE = """
SELECT 'idn-' || email AS id, cf AS first_name, cl AS last_name, email,
       CAST(CASE WHEN k % 9 = 0 THEN NULL ELSE 95 END AS INT) AS confidence_score,
       'email' AS confidence_source
FROM (
  SELECT lower(trim(raw_email)) AS email, min(row_index) AS k, min(f) AS cf, min(l) AS cl
  FROM {raw_import}
  WHERE import_id = '1-URGENT' AND raw_email IS NOT NULL
  GROUP BY lower(trim(raw_email))
) AS people
"""
IDENTITY_CACHE_KEYS = """
SELECT 'email' AS key_type, lower(trim(raw_email)) AS key_value,
       'idn-' || lower(trim(raw_email)) AS identity_cache_id
FROM {raw_import} WHERE import_id = '1-URGENT' AND raw_email IS NOT NULL
GROUP BY lower(trim(raw_email))
UNION ALL
SELECT 'username', username, CASE WHEN k % 10 = 0 THEN 'idn-' || other ELSE 'idn-' || own END
FROM (
  SELECT replace(lower(raw_username), '@', '') AS username, min(row_index) AS k,
         min(lower(trim(raw_email))) AS own, max(lower(trim(raw_email))) AS other
  FROM {raw_import}
  WHERE import_id = '1-URGENT' AND raw_email IS NOT NULL AND raw_username IS NOT NULL
  GROUP BY replace(lower(raw_username), '@', '')
) AS handles
"""

# reviewer actions on the records
REVIEW_ACTIONS = """
SELECT k AS seq, import_id, k AS row_index,
  CASE WHEN k % 50 < 10 THEN 'approve' WHEN k % 50 < 18 THEN 'ignore'
       WHEN k % 50 = 18 THEN 'archive' WHEN k % 50 < 30 THEN 'override'
       ELSE 'none' END AS action,
  CASE k % 4 WHEN 0 THEN 'firstName' WHEN 1 THEN 'email' WHEN 2 THEN 'socialHandle'
       ELSE 'nickname' END AS field,
  CASE WHEN k % 7 = 0 THEN '  ' ELSE 'fixed ' || CAST(k AS STRING) END AS value,
  CASE WHEN k % 2 = 0 THEN 'typo' ELSE NULL END AS reason
FROM (SELECT import_id, row_index AS k FROM {raw_import}) AS rows_
"""

# a star, a heart with its selector, a crown, a thumb with a skin tone
PICTOGRAPHS = ["\U0001F31F", "\u2764\uFE0F", "\U0001F451", "\U0001F44D\U0001F3FD"]

PROCESSING_LOGS = """
SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS creator_id,
       CAST(event_id AS BIGINT) + 3000000000 AS seq, event_type AS step,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped'
            ELSE 'success' END AS status,
       props AS detail, ts AS created_at
FROM {events}
"""

IMPORT_HISTORY = """
SELECT o_orderpriority AS id, lower(o_orderpriority) || '.csv' AS file_name,
       'csv' AS file_type, count(*) AS row_count,
       CASE WHEN o_orderpriority < '2' THEN 'uploaded' WHEN o_orderpriority < '3' THEN 'mapped'
            WHEN o_orderpriority < '4' THEN 'processing' WHEN o_orderpriority < '5' THEN 'completed'
            ELSE 'failed' END AS status,
       min(o_orderdate) AS created_at
FROM {orders} GROUP BY o_orderpriority
"""


_memo: dict[tuple, object] = {}


def once(build):
    """Build a fixture's plan once per session and data set."""

    def get(spark: SparkSession, sf_dir: str, *rest):
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir, *rest)
        if key not in _memo:
            _memo[key] = build(spark, sf_dir, *rest)
        return _memo[key]

    return get


def forget() -> None:
    """Build everything anew from here on."""
    _memo.clear()


@once
def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    # one file of these would otherwise be worked on by a single task
    spread = table in ("orders", "pages")
    return df.repartition(spark.sparkContext.defaultParallelism) if spread else df


@once
def raw_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        RAW_IMPORT, orders=read(spark, sf_dir, "orders"), part=read(spark, sf_dir, "part")
    )


@once
def stored_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_import`` as a table, for queries that read it again and again."""
    return materialize(raw_import(spark, sf_dir), "raw-import")


def _import(spark: SparkSession, sf_dir: str, stored: bool) -> DataFrame:
    return (stored_import if stored else raw_import)(spark, sf_dir)


def now() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@once
def creators(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    return new_creators(_import(spark, sf_dir, stored), now())


@once
def dictionary(spark: SparkSession, sf_dir: str) -> NameDictionary:
    return NameDictionary(spark.sql(FIRST_NAMES, part=read(spark, sf_dir, "part")))


@once
def profile_pages(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    pages = spark.sql(PROFILE_PAGES, raw_import=_import(spark, sf_dir, stored))
    return materialize(pages, "profile-pages") if stored else pages


@once
def identity_cache(
    spark: SparkSession, sf_dir: str, stored: bool = False
) -> tuple[DataFrame, DataFrame]:
    raw = _import(spark, sf_dir, stored)
    cache = spark.sql(IDENTITY_CACHE, raw_import=raw)
    keys = spark.sql(IDENTITY_CACHE_KEYS, raw_import=raw)
    if stored:
        cache, keys = materialize(cache, "identity-cache"), materialize(keys, "identity-keys")
    return cache, keys


def processing_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROCESSING_LOGS, events=read(spark, sf_dir, "events"))


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REVIEW_ACTIONS, raw_import=raw_import(spark, sf_dir))


def import_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IMPORT_HISTORY, orders=read(spark, sf_dir, "orders"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- records as they look after a run, for the review, report and export queries ----

RESOLVED_CREATORS = """
SELECT CAST(k AS STRING) AS id, import_id, k AS row_index,
  raw_full_name, raw_username, raw_email, raw_profile_url,
  CASE WHEN k % 9 = 0 THEN NULL ELSE f END AS resolved_first_name,
  CASE WHEN k % 4 = 0 THEN NULL ELSE l END AS resolved_last_name,
  CASE WHEN k % 8 = 1 THEN f || ' ' || l ELSE NULL END AS resolved_display_name,
  CASE WHEN k % 11 = 0 THEN 'instagram' ELSE NULL END AS resolved_platform,
  raw_profile_url AS resolved_profile_url,
  CASE WHEN k % 5 = 0 THEN NULL ELSE lower(trim(raw_email)) END AS resolved_email,
  CASE WHEN k % 6 = 0 THEN NULL ELSE replace(raw_username, '@', '') END AS resolved_social_handle,
  CAST(CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 100 WHEN 2 THEN 95 WHEN 3 THEN 80
       WHEN 4 THEN 60 ELSE 0 END AS INT) AS confidence_score,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'full_name' WHEN 2 THEN 'email'
       WHEN 3 THEN 'instagram' WHEN 4 THEN 'username' ELSE NULL END AS confidence_source,
  CASE k % 6 WHEN 0 THEN 'cache_hit' WHEN 4 THEN 'needs_review' WHEN 5 THEN 'failed'
       ELSE 'enriched' END AS processing_status,
  '1.0.0' AS pipeline_version,
  k % 6 >= 4 AS needs_review,
  CASE WHEN k % 13 = 0 THEN 'ignored' WHEN k % 13 = 1 THEN 'approved' ELSE 'pending'
       END AS review_status,
  CASE WHEN k % 17 = 0 THEN 'note ' || CAST(k AS STRING) ELSE NULL END AS notes,
  CASE WHEN k % 3 = 0 THEN 'idn-' || CAST(k % 1000 AS STRING) ELSE NULL END AS identity_cache_id,
  CASE WHEN k % 29 = 1 THEN CAST(k - 1 AS STRING) ELSE NULL END AS duplicate_of_creator_id
FROM (SELECT *, row_index AS k FROM {raw_import}) AS source
"""

# every record of an import that shares an e-mail is merged into the first of them;
# some requests are invalid
MERGE_PAIRS = """
SELECT r.row_index AS seq, CAST(r.row_index AS STRING) AS source_id,
  CASE WHEN r.row_index % 40 = 3 THEN CAST(r.row_index AS STRING)
       WHEN r.row_index % 40 = 5 THEN 'nobody' ELSE CAST(g.keep AS STRING) END AS target_id
FROM {raw_import} AS r
JOIN (SELECT import_id, lower(trim(raw_email)) AS email, min(row_index) AS keep
      FROM {raw_import} WHERE raw_email IS NOT NULL
      GROUP BY import_id, lower(trim(raw_email))) AS g
  ON g.import_id = r.import_id AND g.email = lower(trim(r.raw_email))
WHERE r.row_index <> g.keep
"""

# within some fifty neighbours of an import each record is merged into the one before, in order
MERGE_CHAINS = """
SELECT seq, source_id, target_id FROM (
  SELECT row_index AS seq, CAST(row_index AS STRING) AS source_id,
    CAST(lag(row_index) OVER (PARTITION BY import_id, row_index - row_index % 1000
                              ORDER BY row_index) AS STRING) AS target_id
  FROM {raw_import}) AS chained
WHERE target_id IS NOT NULL
"""

UNMERGE_REQUESTS = """
SELECT row_index AS seq,
  CASE WHEN row_index % 100 = 7 THEN 'nobody' ELSE CAST(row_index AS STRING) END AS creator_id
FROM {raw_import} WHERE row_index % 3 <> 0
"""

OVERRIDES = """
SELECT seq, CAST(row_index AS STRING) AS creator_id, field, value, reason
FROM {actions} WHERE action = 'override'
UNION ALL
SELECT seq + 1000000000, CAST(row_index AS STRING), field, 'again ' || CAST(seq AS STRING), reason
FROM {actions} WHERE action = 'override' AND seq % 3 = 0
"""

# users of the event stream as records, five imports
USERS = """
SELECT CAST(user_id AS STRING) AS id, 'users-' || CAST(user_id % 5 AS STRING) AS import_id,
       user_id AS row_index
FROM {events} GROUP BY user_id
"""

JOB_ITEMS = """
SELECT 'job-' || import_id AS job_id, CAST(row_index AS STRING) AS creator_id, row_index,
  CASE WHEN row_index % 50 < 30 AND row_index < 900 THEN 'done'
       WHEN row_index % 7 = 0 THEN 'failed' WHEN row_index % 7 = 1 THEN 'processing'
       ELSE 'pending' END AS status,
  CAST(row_index % 3 AS INT) AS attempts
FROM {raw_import}
"""

# exports: one per order of the two smallest imports' first days
EXPORT_HISTORY = """
SELECT 'exp-' || CAST(o_orderkey AS STRING) AS id, o_orderpriority AS import_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'quick' ELSE 'full' END AS export_type,
  'export-' || CAST(o_orderkey AS STRING) || '.csv' AS file_name,
  o_custkey AS row_count, o_orderdate AS created_at
FROM {orders}
"""

HEADERS = """
SELECT DISTINCT CASE k % 12
    WHEN 0 THEN ' Full_Name ' WHEN 1 THEN 'E-MAIL' WHEN 2 THEN 'Instagram  Handle'
    WHEN 3 THEN 'user-name' WHEN 4 THEN 'Channel' WHEN 5 THEN 'contact--email'
    WHEN 6 THEN 'tiktok_url' WHEN 7 THEN upper(f) WHEN 8 THEN f || ' ' || l
    WHEN 9 THEN f || '_email' WHEN 10 THEN 'NAME' ELSE 'link' END AS header
FROM (SELECT row_index AS k, f, l FROM {raw_import}) AS rows_
"""

SHEET = """
SELECT row_index, raw_full_name AS "Full Name", raw_email AS "Email Address",
  CASE WHEN row_index % 2 = 0 THEN raw_profile_url ELSE '  ' END AS "Instagram",
  CASE WHEN row_index % 3 = 0 THEN raw_profile_url ELSE '' END AS "TikTok",
  raw_username AS "Handle", f AS "Notes"
FROM {raw_import}
"""
SHEET_MAPPING = {
    "Full Name": "fullName", "Email Address": "email", "Instagram": "profileUrl",
    "TikTok": "profileUrl", "Handle": "username",
}


def resolved_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RESOLVED_CREATORS, raw_import=raw_import(spark, sf_dir))
    return conform(rows.withColumns({"created_at": now(), "updated_at": now()}), CREATORS)


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture that only depends on raw_import."""
    return spark.sql(text, raw_import=raw_import(spark, sf_dir))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OVERRIDES, actions=review_actions(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(USERS, events=read(spark, sf_dir, "events"))
    return conform(rows, CREATORS)


def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EXPORT_HISTORY, orders=read(spark, sf_dir, "orders"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark takes double quotes for strings, so the column names need backticks
    return derived(spark, sf_dir, SHEET.replace('"', "`"))


BIO = """CASE WHEN row_index % 2 = 0 THEN concat('row ', row_index, chr(10), '"said", ok') ELSE 'plain' END"""
# a header, a line for each order, and after nine tenths of the keys a quote that stays open
DAMAGED_CSV = """
SELECT o_orderpriority AS priority, o_orderkey AS at, 1 AS nth,
  concat(o_orderkey, ',', CASE WHEN o_orderkey % 97 = 5 THEN cast(unhex('636166FF') AS string)
                               ELSE o_orderstatus END) AS line
FROM {orders}
UNION ALL
SELECT o_orderpriority, -1, 0, 'key,"status, as text"' FROM {orders} GROUP BY o_orderpriority
UNION ALL
SELECT o_orderpriority, (SELECT max(o_orderkey) FROM {orders}) * 9 div 10, 2, 'open,"never closed'
FROM {orders} GROUP BY o_orderpriority
"""

# a record's micro-batch is the remainder of its row_index
STREAM_BATCHES = 4
