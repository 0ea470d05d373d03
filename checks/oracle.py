"""The registered queries as plain SQL for DuckDB, written independently of the engine.

Each oracle is one statement: common table expressions that start at the given tables,
then the query's own SELECT. The regular expressions are RE2, so rules that need
look-around or back-references are spelled differently than in the engine.
"""

from __future__ import annotations

import re

from checks import fixtures as X
from personae.config import (
    COLUMN_ALIASES,
    DESCRIPTORS,
    EVIDENCE_LABELS,
    IMPORT_STATUS_LABELS,
    NEXT_ACTIONS,
    OVERRIDABLE_FIELDS,
)

ORACLES: dict[str, str] = {}
FIELDS = list(OVERRIDABLE_FIELDS.values())


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(dict.fromkeys(ctes)) + "\n" + select


def cte(name: str, text: str) -> str:
    return f"{name} AS ({text})"


# --- fixtures -------------------------------------------------------------------------

RAW = [cte("raw_import", X.RAW_IMPORT.format(orders="orders", part="part"))]
DICT = [cte("dict", X.FIRST_NAMES.format(part="part"))]
PAGES = RAW + [cte("fixture_pages", X.PROFILE_PAGES.format(raw_import="raw_import"))]
CACHE = RAW + [
    cte("cache", X.IDENTITY_CACHE.format(raw_import="raw_import")),
    cte("cache_keys", X.IDENTITY_CACHE_KEYS.format(raw_import="raw_import")),
]
NO_CACHE = [
    cte("cache", "SELECT '' AS id, '' AS first_name, '' AS last_name, '' AS email, "
                 "0 AS confidence_score, '' AS confidence_source WHERE false"),
    cte("cache_keys", "SELECT '' AS key_type, '' AS key_value, '' AS identity_cache_id WHERE false"),
]
RESOLVED = RAW + [cte("res", X.RESOLVED_CREATORS.format(raw_import="raw_import"))]
ACTIONS = RAW + [cte("actions", X.REVIEW_ACTIONS.format(raw_import="raw_import"))]
LOGS = [cte("logs", X.PROCESSING_LOGS.format(events="events"))]
IMPORTS = [cte("imports", X.IMPORT_HISTORY.format(orders="orders"))]
SHEET = RAW + [cte("sheet", X.SHEET.format(raw_import="raw_import"))]
STAMP = "%Y-%m-%d %H:%M:%S.%f"


def moment(c: str) -> str:
    return f"strftime({c}, '{STAMP}')"


# --- text -----------------------------------------------------------------------------


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def by_length(words: list[str]) -> list[str]:
    return sorted(words, key=len, reverse=True)


WORDS = "(?i)\\b(?:" + "|".join(by_length(DESCRIPTORS)) + ")\\b"
SUFFIXES = "|".join(
    dict.fromkeys("".join(c for c in d if c.isalpha()) for d in by_length(DESCRIPTORS))
)
WITHOUT_SUFFIX = f"'(?is)^(.{{2,}}?)(?:{SUFFIXES})$', '\\1'"


def undecorated(e: str) -> str:
    e = f"strip_accents(split_part({e}, '|', 1))"
    for ch in ".,;:|/_-–—":
        shown = ch if ch in ",;:/_–—" else f"\\{ch}"
        e = f"regexp_replace({e}, '{shown}{{2,}}', '{ch}', 'g')"
    e = squeeze(e)
    e = f"regexp_replace({e}, {q(WORDS)}, '', 'g')"
    e = f"regexp_replace({e}, '(?i)\\bof\\s+\\d+\\b', '', 'g')"
    e = f"regexp_replace({e}, '^[\\s.,;:|/_\\-–—]+|[\\s.,;:|/_\\-–—]+$', '', 'g')"
    return squeeze(e)


def title(e: str) -> str:
    words = f"list_transform(string_split(lower({e}), ' '), lambda w: upper(w[1:1]) || w[2:])"
    return (
        f"CASE WHEN regexp_matches({e}, '[a-z]') <> regexp_matches({e}, '[A-Z]') "
        f"THEN array_to_string({words}, ' ') ELSE {e} END"
    )


def cleaned(name: str, source: str, columns: dict[str, str]) -> list[str]:
    """CTEs that add the cleaned text of {new column: expression}."""
    first = ", ".join(f"{undecorated(e)} AS _{c}" for c, e in columns.items())
    second = ", ".join(
        f"CASE WHEN regexp_matches(_{c}, '\\s') THEN _{c} "
        f"ELSE regexp_replace(_{c}, {WITHOUT_SUFFIX}) END AS _{c}"
        for c in columns
    )
    third = ", ".join(f"nullif({title('_' + c)}, '') AS {c}" for c in columns)
    return [
        cte(f"{name}_1", f"SELECT *, {first} FROM {source}"),
        cte(f"{name}_2", f"SELECT * REPLACE ({second}) FROM {name}_1"),
        cte(name, f"SELECT * EXCLUDE ({', '.join('_' + c for c in columns)}), {third} "
                  f"FROM {name}_2"),
    ]


def tokens(e: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({e}, '[._-]+'), "
        f"lambda t: regexp_replace(t, '^\\d+|\\d+$', '', 'g')), lambda t: t <> '')"
    )


def canonical_url(e: str) -> str:
    pattern = (
        "^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\\.)?([^/:?#]+)(?::\\d+)?([^?#]*?)/*"
        "(?:[?#].*)?$"
    )
    return f"regexp_replace(lower(trim({e})), '{pattern}', '\\1\\2')"


def platform(e: str) -> str:
    host = f"regexp_extract(lower({e}), '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1)"
    return (
        f"CASE WHEN regexp_matches({host}, '(^|\\.)instagram\\.com$') THEN 'instagram' "
        f"WHEN regexp_matches({host}, '(^|\\.)tiktok\\.com$') THEN 'tiktok' "
        f"WHEN regexp_matches({host}, '(^|\\.)(facebook|fb)\\.com$') THEN 'facebook' "
        f"WHEN regexp_matches({host}, '(^|\\.)youtube\\.com$|^youtu\\.be$') THEN 'youtube' "
        f"ELSE 'generic' END"
    )


# --- normalized records and keys -------------------------------------------------------------

NORM = RAW + cleaned("named", "raw_import", {"n_full_name": "raw_full_name"}) + [
    cte("norm", f"""
  SELECT sha256(import_id || '|' || CAST(row_index AS VARCHAR)) AS id, import_id, row_index,
    n_full_name,
    nullif(regexp_replace({squeeze('raw_username')}, '^@', ''), '') AS n_username,
    nullif(lower({squeeze('raw_email')}), '') AS n_email,
    nullif({squeeze('raw_profile_url')}, '') AS n_profile_url,
    CAST(NULL AS VARCHAR) AS n_platform
  FROM named""")
]


def key_rows(source: str, columns: str, email: str, username: str, url: str) -> str:
    parts = [
        ("email", f"lower(trim({email}))"),
        ("username", f"regexp_replace(lower(trim({username})), '^@', '')"),
        ("profile_url", canonical_url(url)),
    ]
    return " UNION ALL ".join(
        f"SELECT {columns}, {pos} AS key_pos, '{kind}' AS key_type, {e} AS key_value "
        f"FROM {source} WHERE {e} <> ''"
        for pos, (kind, e) in enumerate(parts)
    )


LOOKUP_KEYS = NORM + [
    cte("lookup_keys", key_rows("norm", "id, row_index, import_id", "n_email", "n_username",
                                "n_profile_url"))
]

# --- candidates ---------------------------------------------------------------------------


def candidates_of(source: str, suffix: str = "") -> list[str]:
    """Full-name, username and e-mail candidates of ``source`` (same columns as norm)."""
    s = suffix
    return DICT + [
        cte(f"full_words{s}", f"SELECT id, list_filter(regexp_split_to_array(trim(n_full_name), "
                              f"'\\s+'), lambda t: t <> '') AS w FROM {source}"),
        cte(f"c_full{s}", f"""
  SELECT id, 0 AS ord, 'full_name' AS source, w[1] AS first_name,
    CASE WHEN len(w) >= 2 THEN w[-1] END AS last_name, CAST(NULL AS VARCHAR) AS display_name,
    CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS profile_url,
    CAST(NULL AS VARCHAR) AS handle, CAST(NULL AS VARCHAR) AS email, 100 AS confidence,
    false AS ambiguous, false AS handle_fallback, false AS business_like,
    CASE WHEN len(w) > 2 THEN w[2] END AS dropped
  FROM full_words{s} WHERE len(w) > 0"""),
        cte(f"mail_tokens{s}", f"SELECT id, n_email, {tokens('split_part(trim(n_email), $$@$$, 1)')}"
                               f" AS t FROM {source}"),
        cte(f"mail_known{s}", f"""
  SELECT *, len(t) AS n, coalesce(lower(t[1]) IN (SELECT name FROM dict), false) AS a,
    coalesce(lower(t[2]) IN (SELECT name FROM dict), false) AS b
  FROM mail_tokens{s} WHERE len(t) > 0"""),
        cte(f"c_email{s}", f"""
  SELECT id, 2 AS ord, 'email' AS source,
    CASE WHEN n = 2 AND b AND NOT a THEN t[2] ELSE t[1] END AS first_name,
    CASE WHEN n = 1 THEN NULL WHEN n = 2 AND b AND NOT a THEN t[1] ELSE t[-1] END AS last_name,
    NULL AS display_name, NULL AS platform, NULL AS profile_url, NULL AS handle,
    n_email AS email, CASE WHEN n = 2 AND a <> b THEN 95 ELSE 80 END AS confidence,
    NOT (n = 2 AND a <> b) AS ambiguous, false AS handle_fallback, false AS business_like,
    CASE WHEN n = 2 THEN CASE WHEN a AND NOT b THEN 'first_last' WHEN b AND NOT a
         THEN 'last_first' ELSE 'first_last_default' END END AS name_order
  FROM mail_known{s}"""),
        cte(f"user_tokens{s}", f"""
  SELECT id, trim(n_username) AS u,
    {tokens(f"regexp_replace(trim(n_username), {WITHOUT_SUFFIX})")} AS r
  FROM {source} WHERE n_username IS NOT NULL"""),
        cte(f"user_kept{s}", f"""
  SELECT id, u, CASE WHEN len(r) > 1 THEN list_filter(r, lambda t: lower(t) NOT IN
    ({', '.join(map(q, DESCRIPTORS))})) ELSE r END AS t FROM user_tokens{s}"""),
        cte(f"user_known{s}", f"""
  SELECT *, len(t) AS n, lower(t[1]) IN (SELECT name FROM dict) AS a,
    coalesce(lower(t[-1]) IN (SELECT name FROM dict), false) AS b,
    (SELECT max(length(name)) FROM dict WHERE length(name) >= 5
       AND starts_with(lower(t[1]), name) AND length(t[1]) - length(name) >= 4) AS cut
  FROM user_kept{s} WHERE len(t) > 0"""),
        cte(f"user_split{s}", f"""
  SELECT id, u,
    CASE WHEN n = 1 AND a THEN t[1] WHEN n = 1 THEN t[1][1:cut] WHEN a THEN t[1]
         WHEN b THEN t[-1] END AS f0,
    CASE WHEN n = 1 AND a THEN NULL WHEN n = 1 THEN t[1][cut + 1:] WHEN a THEN t[-1]
         WHEN b THEN t[1] END AS l0,
    CASE WHEN n = 1 THEN NOT a AND cut IS NULL ELSE NOT a AND NOT b END AS fb
  FROM user_known{s}"""),
        *cleaned(f"user_clean{s}", f"user_split{s}", {"f1": "f0", "l1": "l0"}),
        cte(f"c_user{s}", f"""
  SELECT id, 1 AS ord, 'username' AS source,
    CASE WHEN fb THEN '@' || u ELSE f1 END AS first_name, CASE WHEN NOT fb THEN l1 END AS last_name,
    NULL AS display_name, NULL AS platform, NULL AS profile_url, NULL AS handle, NULL AS email,
    60 AS confidence, false AS ambiguous, fb AS handle_fallback, false AS business_like
  FROM user_clean{s} WHERE fb OR f1 IS NOT NULL"""),
    ]


def fetch_key(u: str) -> str:
    host = f"lower(regexp_extract({u}, '(?i)^https?://(?:www\\.)?([^/?#]+)', 1))"
    path = f"regexp_replace(regexp_extract({u}, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/+$', '')"
    return f"{host} || {path} || regexp_extract({u}, '\\?[^#]*')"


USABLE = PAGES + [
    cte("usable", "SELECT url, html, 'static' AS fetched_via FROM fixture_pages "
                  "WHERE length(html) >= 2000 UNION ALL SELECT url, html, 'browser' "
                  "FROM fixture_pages WHERE copy = 'browser' AND length(html) < 2000"),
]
FIXTURE_FIELDS = USABLE + [
    cte("page_parts", f"""
  SELECT url, {fetch_key('url')} AS fetched, fetched_via,
    coalesce(nullif(regexp_extract(html, '<meta property="og:title" content="([^"]*)">', 1), ''),
             nullif(regexp_extract(html, '<meta content="([^"]*)" property="og:title">', 1), ''))
      AS og_title,
    nullif(regexp_extract(html, '<meta property="og:description" content="([^"]*)">', 1), '') AS bio,
    nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title
  FROM usable""")
]


def page_candidates_of(source: str, suffix: str = "") -> list[str]:
    s = suffix
    return FIXTURE_FIELDS + [
        cte(f"scraped{s}", f"""
  SELECT r.id, r.n_profile_url AS url, {platform('r.n_profile_url')} AS platform,
    p.url IS NOT NULL AS has_page, p.fetched_via, p.og_title, p.bio, p.title
  FROM {source} r LEFT JOIN page_parts p ON p.fetched = {fetch_key('r.n_profile_url')}
  WHERE r.n_profile_url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY p.url = r.n_profile_url DESC NULLS LAST,
    p.fetched_via = 'static' DESC, coalesce(p.og_title, p.title) IS NOT NULL DESC,
    p.url) = 1"""),
        cte(f"shown{s}", f"""
  SELECT *,
    CASE WHEN platform IN ('instagram', 'tiktok') THEN nullif(trim(split_part(og_title, '(@', 1)), '')
         ELSE nullif(trim(coalesce(og_title, title)), '') END AS shown,
    CASE platform
      WHEN 'instagram' THEN nullif(regexp_extract(url, '(?i)instagram\\.com/([^/?#]+)', 1), '')
      WHEN 'tiktok' THEN nullif(regexp_extract(url, '(?i)tiktok\\.com/@([^/?#]+)', 1), '')
      END AS handle
  FROM scraped{s}"""),
        *cleaned(f"shown_clean{s}", f"shown{s}", {"dname": "shown"}),
        cte(f"judged{s}", f"""
  SELECT *, lower(dname) = platform OR regexp_matches(lower(dname),
      '\\b(log\\s*in|log\\s*into|sign\\s*up|sign\\s*in)\\b') AS placeholder,
    regexp_split_to_array(dname, '\\s+') AS w,
    regexp_matches(split_part(shown, '|', 1), {q(WORDS)}) AS business
  FROM shown_clean{s} WHERE has_page"""),
        cte(f"c_page{s}", f"""
  SELECT id, 3 AS ord, CASE platform WHEN 'generic' THEN 'generic_scrape' ELSE platform END AS source,
    CASE WHEN dname IS NULL THEN '@' || handle ELSE w[1] END AS first_name,
    CASE WHEN len(w) >= 2 THEN w[-1] END AS last_name, dname AS display_name, platform,
    url AS profile_url, handle, NULL AS email,
    CASE platform WHEN 'generic' THEN 55 ELSE 80 END AS confidence, false AS ambiguous,
    dname IS NULL AS handle_fallback, dname IS NOT NULL AND business AS business_like
  FROM judged{s}
  WHERE CASE WHEN dname IS NULL THEN handle IS NOT NULL ELSE NOT placeholder END"""),
    ]


CAND_COLUMNS = (
    "id, ord, source, first_name, last_name, display_name, platform, profile_url, handle, "
    "email, confidence, ambiguous, handle_fallback, business_like"
)


def scoring(source: str, pages: bool, s: str = "") -> list[str]:
    """Winner and resolved identity per record of ``source``: CTE fresh{s}."""
    tables = [f"c_full{s}", f"c_user{s}", f"c_email{s}"] + ([f"c_page{s}"] if pages else [])
    out = candidates_of(source, s) + (page_candidates_of(source, s) if pages else [])
    union = " UNION ALL ".join(f"SELECT {CAND_COLUMNS} FROM {t}" for t in tables)
    return out + [
        cte(f"cands{s}", union),
        cte(f"ranked{s}", f"""
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY plausible DESC, last_resort, verified DESC,
    confidence DESC, ord) AS place
  FROM (SELECT *,
      NOT business_like AND length(trim(coalesce(first_name, display_name, ''))) >= 2
        AND regexp_matches(coalesce(first_name, display_name, ''), '[a-zA-Z]') AS plausible,
      source = 'email' OR handle_fallback AS last_resort,
      NOT handle_fallback AND (source = 'full_name'
        OR coalesce(lower(first_name) IN (SELECT name FROM dict), false)
        OR coalesce(lower(last_name) IN (SELECT name FROM dict), false)) AS verified
    FROM cands{s}) AS judged_candidates"""),
        cte(f"fresh{s}", f"""
  SELECT r.*, {title('w.first_name')} AS first_name, {title('w.last_name')} AS last_name,
    w.display_name, coalesce(w.platform, r.n_platform) AS platform,
    coalesce(w.profile_url, r.n_profile_url) AS profile_url,
    coalesce(w.email, r.n_email) AS email, coalesce(w.handle, r.n_username) AS social_handle,
    coalesce(w.confidence, 0) AS confidence_score, w.source AS confidence_source,
    CASE WHEN w.id IS NULL THEN 'failed' WHEN w.ambiguous OR w.confidence < 70
         THEN 'needs_review' ELSE 'enriched' END AS processing_status,
    (w.id IS NULL OR w.ambiguous OR w.confidence < 70) AS needs_review
  FROM {source} r LEFT JOIN (SELECT * FROM ranked{s} WHERE place = 1) w ON w.id = r.id"""),
    ]


# --- cache lookups and one snapshot run -----------------------------------------------------


def run(pages: bool, cached: bool) -> list[str]:
    """CTEs of a snapshot run; ``final`` has one row per record."""
    base = NORM + (CACHE if cached else NO_CACHE)
    return base + [
        cte("batch", "SELECT * FROM norm"),
        cte("batch_keys", key_rows("batch", "id", "n_email", "n_username", "n_profile_url")),
        cte("found", """
  SELECT b.id, list_sort(list(DISTINCT k.identity_cache_id)) AS ids
  FROM batch_keys b JOIN cache_keys k USING (key_type, key_value) GROUP BY b.id"""),
        cte("looked", """
  SELECT b.*, CASE WHEN f.ids IS NULL THEN 'miss' WHEN len(f.ids) = 1 THEN 'hit' ELSE 'conflict'
    END AS cache_status, f.ids FROM batch b LEFT JOIN found f USING (id)"""),
        cte("unhit", "SELECT * FROM looked WHERE cache_status <> 'hit'"),
        *scoring("unhit", pages),
        cte("write_keys", key_rows(
            "(SELECT * FROM fresh WHERE cache_status = 'miss' AND processing_status = 'enriched')",
            "id, import_id, row_index", "email", "social_handle", "profile_url")),
        cte("write_seen", """
  SELECT w.*, k.identity_cache_id AS owner FROM write_keys w
  LEFT JOIN cache_keys k USING (key_type, key_value)"""),
        cte("write_rows", """
  SELECT id, count(*) AS n_keys, count(DISTINCT owner) AS n_owners, min(owner) AS owner
  FROM write_seen GROUP BY id"""),
        cte("first_writers", """
  SELECT key_type, key_value, arg_min(s.id, (s.import_id, s.row_index)) AS id
  FROM write_seen s JOIN write_rows r USING (id)
  WHERE s.owner IS NULL AND r.n_owners <= 1 GROUP BY key_type, key_value"""),
        cte("writes", """
  SELECT r.id, CASE WHEN n_owners = 1 THEN 'add' ELSE 'create' END AS write_action,
    CASE WHEN n_owners = 1 THEN owner ELSE sha256('identity|' || r.id) END AS write_id
  FROM write_rows r LEFT JOIN (SELECT id, count(*) AS won FROM first_writers GROUP BY id) f USING (id)
  WHERE n_owners = 1 OR (n_owners = 0 AND won = n_keys)"""),
        cte("final", """
  SELECT f.id, f.import_id, f.row_index, f.n_profile_url, f.cache_status, f.ids, f.first_name,
    f.last_name, f.display_name, f.platform, f.profile_url, f.email, f.social_handle,
    f.confidence_score, f.confidence_source,
    CASE WHEN cache_status = 'conflict' AND processing_status <> 'failed' THEN 'needs_review'
         ELSE processing_status END AS processing_status,
    f.needs_review OR (cache_status = 'conflict' AND processing_status <> 'failed') AS needs_review,
    w.write_action, w.write_id, w.write_id AS identity_cache_id
  FROM fresh f LEFT JOIN writes w USING (id)
  UNION ALL
  SELECT l.id, l.import_id, l.row_index, l.n_profile_url, 'hit', l.ids, c.first_name, c.last_name,
    NULL, NULL, NULL, c.email, NULL, coalesce(c.confidence_score, 100), c.confidence_source,
    'cache_hit', false, NULL, NULL, c.id
  FROM looked l JOIN cache c ON c.id = l.ids[1] WHERE l.cache_status = 'hit'"""),
    ]


IDENTITY = ", ".join(FIELDS)
ENRICHED = (
    f"SELECT id, {IDENTITY}, CAST(confidence_score AS BIGINT) AS confidence_score, "
    "confidence_source, processing_status, CAST(needs_review AS BIGINT) AS needs_review, "
    "identity_cache_id FROM final"
)
CANDIDATE = (
    "source, first_name, last_name, CAST(confidence AS BIGINT) AS confidence, "
    "CAST(ambiguous AS BIGINT) AS ambiguous, CAST(handle_fallback AS BIGINT) AS handle_fallback, "
    "CAST(business_like AS BIGINT) AS business_like"
)

# --- sources ------------------------------------------------------------------------------

ORACLES["ingest_payload"] = """
SELECT sha256(import_id || '|' || CAST(row_index AS VARCHAR)) AS id, * FROM (
  SELECT o_orderpriority AS import_id,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS row_index,
    '{"Status":"' || o_orderstatus || '","Customer":"' || CAST(o_custkey AS VARCHAR) || '"}'
      AS raw_payload,
    'failed' AS processing_status, 'pending' AS review_status, '1.0.0' AS pipeline_version,
    CAST(0 AS BIGINT) AS needs_review
  FROM orders) AS numbered"""

ORACLES["payload_fields"] = sql(SHEET, """
SELECT row_index, nullif(trim("Full Name"), '') AS raw_full_name,
  nullif(trim("Email Address"), '') AS raw_email, nullif(trim("Handle"), '') AS raw_username,
  "Notes" AS notes FROM sheet""")

ORACLES["ingest_csv"] = sql(SHEET, """
SELECT 'sheet' AS import_id, row_number() OVER (ORDER BY row_index) - 1 AS row_index,
  nullif(trim("Full Name"), '') AS raw_full_name, nullif(trim("Handle"), '') AS raw_username,
  nullif(trim("Email Address"), '') AS raw_email,
  coalesce(nullif(trim("Instagram"), ''), nullif(trim("TikTok"), '')) AS raw_profile_url,
  CASE WHEN row_index % 2 = 0 THEN 'row ' || row_index || chr(10) || '"said", ok'
       ELSE 'plain' END AS bio
FROM sheet""")

ORACLES["csv_quarantine"] = """
WITH lines AS (
  SELECT o_orderpriority AS priority, o_orderkey AS place, 1 AS nth, o_orderkey % 97 = 5 AS damaged,
    o_orderkey || ',' || CASE WHEN o_orderkey % 97 = 5 THEN 'caf' || chr(65533) ELSE o_orderstatus END AS raw
  FROM orders
  UNION ALL
  SELECT DISTINCT o_orderpriority, -1, 0, false, '' FROM orders
  UNION ALL
  SELECT DISTINCT o_orderpriority, (SELECT max(o_orderkey) FROM orders) * 9 // 10, 2, false, 'open,"never closed'
  FROM orders
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY priority ORDER BY place, nth) AS line,
    max(CASE WHEN nth = 2 THEN place END) OVER (PARTITION BY priority) AS opened
  FROM lines
)
SELECT priority, 0 AS line, CAST(count(*) AS VARCHAR) AS raw, 'rows' AS reason, 1 AS kept
FROM numbered WHERE nth = 1 AND place <= opened GROUP BY priority
UNION ALL
SELECT priority, line, raw, CASE WHEN place > opened OR nth = 2 THEN 'unclosed_quote' ELSE 'bad_encoding' END,
  CASE WHEN place > opened OR nth = 2 THEN 0 ELSE 1 END
FROM numbered WHERE place > opened OR nth = 2 OR damaged"""

ORACLES["file_routing"] = """
SELECT k, file_name, file_type,
  CASE WHEN file_type IS NULL THEN 'file_type_unknown'
       WHEN file_type = 'xlsx' THEN 'workbook' END AS reject_reason
FROM (SELECT o_orderkey AS k,
    o_orderpriority || (['.CSV', '.xlsx', '.xls', '.txt'])[o_orderkey % 4 + 1] AS file_name,
    (['csv', 'xlsx', 'xlsx', NULL])[o_orderkey % 4 + 1] AS file_type FROM orders) AS files"""

ALIAS_ROWS = ", ".join(
    f"({pos}, '{field}', '{alias}')"
    for pos, (field, names) in enumerate(COLUMN_ALIASES.items())
    for alias in names
)


def header(e: str) -> str:
    return (f"regexp_replace(regexp_replace(trim(lower({e})), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')")


ORACLES["suggest_mapping"] = sql(
    RAW + [cte("headers", X.HEADERS.format(raw_import="raw_import")),
           f"aliases(pos, field, alias) AS (VALUES {ALIAS_ROWS})"],
    f"SELECT header, arg_min(field, pos) AS field FROM headers JOIN aliases "
    f"ON {header('header')} = {header('alias')} GROUP BY header")

ORACLES["apply_mapping"] = sql(SHEET, """
SELECT row_index, nullif(trim("Full Name"), '') AS raw_full_name,
  nullif(trim("Handle"), '') AS raw_username, nullif(trim("Email Address"), '') AS raw_email,
  coalesce(nullif(trim("Instagram"), ''), nullif(trim("TikTok"), '')) AS raw_profile_url,
  CAST(NULL AS VARCHAR) AS raw_platform FROM sheet""")

ORACLES["edited_mapping"] = sql(SHEET, """
SELECT row_index, coalesce(nullif(trim("Full Name"), ''), nullif(trim("Notes"), '')) AS raw_full_name,
  nullif(trim("TikTok"), '') AS raw_profile_url FROM sheet""")

ORACLES["confirm_mapping"] = sql(NORM + IMPORTS, """
SELECT 'preview' AS part, CAST(row_index AS VARCHAR) AS key,
  coalesce(n_full_name, '-') || '/' || coalesce(n_email, '-') AS value
FROM (SELECT * FROM norm ORDER BY row_index LIMIT 20) AS head
UNION ALL
SELECT 'import', id, CASE WHEN id = '2-HIGH' THEN 'mapped/' || (SELECT count(*) FROM norm)
  ELSE status || '/' || row_count END FROM imports""")

ORACLES["validate_rows"] = sql(RESOLVED, """
SELECT row_index, array_to_string(list_filter([
    CASE WHEN row_index % 41 = 0 THEN 'import_id: missing' END,
    CASE WHEN row_index % 31 = 0 THEN 'review_status: not allowed' END,
    CASE WHEN row_index % 37 = 0 THEN 'confidence_score: out of range' END],
    lambda v: v IS NOT NULL), ',') AS violations
FROM res WHERE row_index % 41 = 0 OR row_index % 31 = 0 OR row_index % 37 = 0""")

# --- text and keys ------------------------------------------------------------------------

ORACLES["normalize"] = sql(
    NORM, "SELECT id, n_full_name, n_username, n_email, n_profile_url, n_platform FROM norm")

ORACLES["clean_names"] = sql(
    [cte("texts", "SELECT p_partkey AS k, 'Dr. ' || p_name || ' --, ' || upper(p_type) || "
                  "' of 3 | tag' AS text FROM part")] + cleaned("done", "texts", {"name": "text"}),
    "SELECT k, name FROM done")

ORACLES["descriptor_words"] = f"""
SELECT doc_id, count(*) AS words,
  count(*) FILTER (WHERE lower(word) IN ({', '.join(map(q, DESCRIPTORS))})) AS descriptors,
  count(*) FILTER (WHERE regexp_matches(word, {q(WORDS)})) AS containing
FROM (SELECT doc_id, unnest(regexp_split_to_array(text,
    '[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+'
  )) AS word FROM documents) AS split_words
WHERE word <> '' GROUP BY doc_id"""

ORACLES["handle_tokens"] = sql(NORM, f"""
SELECT id, array_to_string({tokens('n_username')}, ',') AS tokens,
  regexp_replace(n_username, {WITHOUT_SUFFIX}) AS without_suffix
FROM norm WHERE n_username IS NOT NULL""")

ORACLES["canonical_keys"] = sql(
    LOOKUP_KEYS, "SELECT id, key_type, key_value FROM lookup_keys")

ORACLES["platform"] = sql(RAW + [cte("urls", """
  SELECT row_index AS k, raw_profile_url AS url FROM raw_import WHERE raw_profile_url IS NOT NULL
  UNION ALL SELECT -page_id - 1, url FROM pages""")],
    f"SELECT k, {canonical_url('url')} AS canonical, {platform('url')} AS platform FROM urls")

# --- candidates ----------------------------------------------------------------------------

CANDS = NORM + candidates_of("norm")
ORACLES["cand_full_name"] = sql(CANDS, f"SELECT id, {CANDIDATE}, dropped FROM c_full")
ORACLES["cand_email"] = sql(CANDS, f"SELECT id, {CANDIDATE}, name_order FROM c_email")
ORACLES["cand_username"] = sql(CANDS, f"SELECT id, {CANDIDATE} FROM c_user")

ORACLES["prefix_split"] = sql(RAW + DICT, """
SELECT CAST(row_index AS VARCHAR) AS id, f || l AS token, CAST((SELECT max(length(name)) FROM dict
    WHERE length(name) >= 5 AND starts_with(f || l, name)
      AND length(f || l) - length(name) >= 4) AS VARCHAR) AS cut
FROM raw_import""")

ORACLES["doc_emails"] = sql(
    [cte("wild", "SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, "
                 "'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS n_email FROM documents"),
     cte("mails", "SELECT doc_id || '|' || n_email AS id, doc_id, n_email, CAST(NULL AS VARCHAR) "
                  "AS n_full_name, CAST(NULL AS VARCHAR) AS n_username FROM wild")]
    + candidates_of("mails"),
    f"SELECT m.doc_id, m.n_email, {CANDIDATE} FROM c_email JOIN mails m USING (id)")

PLAIN = (
    "regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>"
    "|<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
)


def unescaped(e: str) -> str:
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
             ("&nbsp;", " "), ("&amp;", "&")]
    for name, text in pairs:
        e = f"replace({e}, {q(name)}, {q(text)})"
    return e


TITLE = unescaped(f"regexp_extract({PLAIN}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")
ORACLES["page_fields"] = f"""
SELECT page_id, nullif(trim({TITLE}), '') AS title,
  nullif(regexp_extract({PLAIN}, '(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1), '')
    AS og_title,
  nullif(regexp_extract({PLAIN}, '(?is)<meta[^>]*property="og:description"[^>]*content="([^"]*)"', 1), '')
    AS og_description,
  CAST(length(html) >= 2000 AS BIGINT) AS usable
FROM pages"""

ORACLES["usable_profile_pages"] = sql(
    USABLE, "SELECT url, fetched_via, length(html) AS html_length FROM usable")

PAGE_CANDS = NORM + page_candidates_of("norm")
ORACLES["page_candidates"] = sql(PAGE_CANDS, """
SELECT s.id, s.platform AS scrape_platform,
  CASE WHEN NOT s.has_page THEN 'page_not_found' END AS scrape_error, s.fetched_via,
  c.source, c.first_name, c.last_name, c.display_name, c.handle,
  CAST(c.confidence AS VARCHAR) AS confidence,
  CAST(CAST(c.business_like AS INT) AS VARCHAR) AS business_like,
  CAST(CAST(c.handle_fallback AS INT) AS VARCHAR) AS handle_fallback,
  s.og_title AS snapshot_title
FROM scraped s LEFT JOIN c_page c USING (id)""")

# --- text beyond ASCII -----------------------------------------------------------------------

ORACLES["folded_text"] = """
SELECT doc_id, md5(strip_accents(text)) AS folded, md5(strip_accents(text)) AS folded_wide
FROM documents"""
SPACES = ", ".join(q(" " * len(p)) for p in X.PICTOGRAPHS)
ORACLES["emoji_to_space"] = f"""
SELECT doc_id, md5(replace(text, '.', '.' || [{SPACES}][doc_id % {len(X.PICTOGRAPHS)} + 1])) AS plain
FROM documents"""


def capitals(joint: str) -> str:
    words = f"string_split(replace(p_name, ' ', {joint}), {joint})"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1:1]) || w[2:]), {joint})"


JOINTS = {0: "' '", 1: "chr(39)", 2: "'-'"}
CAPITALS = "CASE p_partkey % 3 " + " ".join(
    f"WHEN {k} THEN {capitals(j)}" for k, j in JOINTS.items()) + " END"
ORACLES["title_cased"] = f"""
SELECT p_partkey, {CAPITALS} AS lower, {CAPITALS} AS upper,
  'Mc' || replace(p_name, ' ', [' ', chr(39), '-'][p_partkey % 3 + 1]) AS mixed FROM part"""
ORACLES["snake_cased"] = """
SELECT p_partkey, 'raw_' || replace(lower(p_name), ' ', '_') AS snake FROM part"""
ORACLES["event_dates"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tokyo FROM events"""

# --- scoring ---------------------------------------------------------------------------------

SCORED = NORM + scoring("norm", True)
ORACLES["score_winner"] = sql(SCORED, """
SELECT id, first_name AS w_first_name, last_name AS w_last_name, display_name AS w_display_name,
  confidence_source AS w_confidence_source, CAST(confidence_score AS BIGINT) AS w_confidence_score,
  processing_status AS w_processing_status, CAST(needs_review AS BIGINT) AS w_needs_review
FROM fresh""")
ORACLES["score_array"] = sql(NORM + scoring("norm", False), """
SELECT f.id, coalesce(n, 0) AS candidates, first_name AS w_first_name, last_name AS w_last_name,
  confidence_source AS w_confidence_source, processing_status AS w_processing_status
FROM fresh f LEFT JOIN (SELECT id, count(*) AS n FROM cands GROUP BY id) AS counted USING (id)""")
ORACLES["resolved"] = sql(SCORED, f"SELECT id, {IDENTITY} FROM fresh")

# --- cache and enrichment ---------------------------------------------------------------------

LATER = run(True, True)
ORACLES["cache_lookup"] = sql(
    LATER, "SELECT id, cache_status, coalesce(array_to_string(ids, ','), '') AS identities FROM looked")
ORACLES["cache_identities"] = sql(LATER, """
SELECT b.id, key_type, identity_cache_id, c.first_name AS c_first_name, c.last_name AS c_last_name,
  c.email AS c_email
FROM batch_keys b JOIN cache_keys USING (key_type, key_value)
LEFT JOIN cache c ON c.id = identity_cache_id""")
ORACLES["enrich_snapshot"] = sql(run(False, False), ENRICHED)


def stream() -> str:
    """One snapshot run after another; each starts from what the earlier ones wrote."""
    fields = "first_name, last_name, display_name, platform, profile_url, email, social_handle, "
    fields += "confidence_score, confidence_source"
    steps = [c for c in run(False, False) if c not in NORM + NO_CACHE]
    names = [re.match(r"\w+", c).group() for c in steps] + ["cache", "cache_keys"]
    any_name = re.compile(rf"\b({'|'.join(sorted(names, key=len, reverse=True))})\b(?!['(])")
    nothing = ", ".join(f"'' AS {f}" if "score" not in f else f"0 AS {f}" for f in fields.split(", "))
    out = NORM + [
        cte("cache_0", f"SELECT '' AS id, {nothing} WHERE false"),
        cte("cache_keys_0", "SELECT '' AS key_type, '' AS key_value, '' AS identity_cache_id WHERE false"),
    ]
    for n in range(X.STREAM_BATCHES):
        for step in steps:
            step = step.replace(
                "NULL, NULL, NULL, c.email, NULL, coalesce",
                "c.display_name, c.platform, c.profile_url, c.email, c.social_handle, coalesce",
            )
            step = any_name.sub(lambda m, n=n: f"{m.group()}_{n}", step)
            if step.startswith(f"batch_{n} "):
                step = cte(f"batch_{n}", f"SELECT * FROM norm WHERE row_index % {X.STREAM_BATCHES} = {n}")
            out.append(step)
        out += [
            cte(f"cache_{n + 1}", f"SELECT * FROM cache_{n} UNION ALL SELECT write_id, {fields} "
                                  f"FROM final_{n} WHERE write_action = 'create'"),
            cte(f"cache_keys_{n + 1}", f"SELECT * FROM cache_keys_{n} UNION ALL SELECT key_type, "
                f"key_value, write_id FROM first_writers_{n} JOIN writes_{n} USING (id)"),
        ]
    parts = [ENRICHED.replace("FROM final", f", {n} AS batch_id FROM final_{n}").replace(
        "identity_cache_id ,", "identity_cache_id,") for n in range(X.STREAM_BATCHES)]
    return sql(out, " UNION ALL ".join(parts))


ORACLES["enrich_stream"] = stream()


def in_order() -> list[str]:
    """CTEs of a run in which each record sees what all earlier ones wrote.

    ``state`` is the definition: one step for each record, in order. It holds the owner of
    every key and the outcome of every record that shares a key with a record that may write
    it; nothing can depend on the others, whose outcome follows from their own evidence.
    """
    keys = "list(key_type || '|' || key_value) AS keys"
    writers = "(SELECT * FROM fresh WHERE processing_status = 'enriched')"
    return NORM + NO_CACHE + scoring("norm", True) + [
        cte("read_keys", key_rows("norm", "id", "n_email", "n_username", "n_profile_url")),
        cte("kept_keys", key_rows(writers, "id", "email", "social_handle", "profile_url")),
        cte("touching", """
  SELECT key_type, key_value, id, bool_or(w) AS w FROM (
    SELECT id, key_type, key_value, false AS w FROM read_keys
    UNION ALL SELECT id, key_type, key_value, true FROM kept_keys) AS both_kinds
  GROUP BY ALL"""),
        cte("contested", """
  SELECT DISTINCT t.id FROM touching t JOIN (
    SELECT key_type, key_value FROM touching GROUP BY ALL
    HAVING count(*) > 1 AND bool_or(w)) AS shared USING (key_type, key_value)"""),
        cte("all_evidence", f"""
  SELECT f.id, f.import_id, f.row_index, coalesce(r.keys, []) AS r, coalesce(w.keys, []) AS w,
    c.id IS NOT NULL AS contested
  FROM fresh f
  LEFT JOIN (SELECT id, {keys} FROM read_keys GROUP BY id) AS r USING (id)
  LEFT JOIN (SELECT id, {keys} FROM kept_keys GROUP BY id) AS w USING (id)
  LEFT JOIN contested c USING (id)"""),
        cte("evidence", """
  SELECT row_number() OVER (ORDER BY import_id, row_index) AS n, id, r, w
  FROM all_evidence WHERE contested"""),
        cte("state(kind, name, owner, status, n) USING KEY (kind, name)", """
  SELECT '', '', NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT
  UNION
  (WITH cur AS (SELECT e.* FROM state s JOIN evidence e ON e.n = s.n + 1 WHERE s.kind = ''),
    looked AS (SELECT list_sort(list(DISTINCT o.owner)) AS ids
      FROM (SELECT unnest(r) AS k FROM cur) AS x
      JOIN recurring.state o ON o.kind = 'key' AND o.name = x.k),
    owned AS (SELECT x.k, o.owner FROM (SELECT unnest(w) AS k FROM cur) AS x
      LEFT JOIN recurring.state o ON o.kind = 'key' AND o.name = x.k),
    verdict AS (SELECT cur.id, cur.n, coalesce(len(ids), 0) AS found, ids[1] AS hit,
        CASE WHEN coalesce(len(ids), 0) = 0 AND len(cur.w) > 0 THEN
          CASE (SELECT count(DISTINCT owner) FROM owned)
            WHEN 0 THEN sha256('identity|' || cur.id)
            WHEN 1 THEN (SELECT min(owner) FROM owned) END END AS wrote
      FROM cur, looked)
    SELECT '', '', NULL, NULL, n FROM verdict
    UNION ALL SELECT 'id', id, CASE found WHEN 0 THEN wrote WHEN 1 THEN hit END,
      CASE found WHEN 0 THEN 'miss' WHEN 1 THEN 'hit' ELSE 'conflict' END, n FROM verdict
    UNION ALL SELECT 'key', k, wrote, NULL, n FROM verdict, owned
      WHERE wrote IS NOT NULL AND owner IS NULL)"""),
        cte("outcome", """
  SELECT name AS id, status, owner FROM state WHERE kind = 'id'
  UNION ALL SELECT id, 'miss', CASE WHEN len(w) > 0 THEN sha256('identity|' || id) END
  FROM all_evidence WHERE NOT contested"""),
        cte("final", """
  SELECT f.id, o.status AS cache_status, o.owner AS identity_cache_id, f.first_name, f.last_name,
    f.display_name, f.platform, f.profile_url, f.email, f.social_handle, f.confidence_score,
    f.confidence_source,
    CASE WHEN o.status = 'conflict' AND processing_status <> 'failed' THEN 'needs_review'
      ELSE processing_status END AS processing_status,
    f.needs_review OR (o.status = 'conflict' AND processing_status <> 'failed') AS needs_review
  FROM fresh f JOIN outcome o USING (id) WHERE o.status <> 'hit'
  UNION ALL
  SELECT o.id, 'hit', o.owner, c.first_name, c.last_name, c.display_name, c.platform,
    c.profile_url, c.email, c.social_handle, c.confidence_score, c.confidence_source,
    'cache_hit', false
  FROM outcome o JOIN fresh c ON o.owner = sha256('identity|' || c.id) WHERE o.status = 'hit'"""),
    ]


IN_ORDER = in_order()
ORACLES["enrich_sequential"] = sql(IN_ORDER, ENRICHED)
ORACLES["sequential_snapshots"] = sql(IN_ORDER, """
SELECT s.id AS creator_id, s.platform, s.fetched_via, s.og_title, s.bio
FROM scraped s JOIN final f USING (id) WHERE s.has_page AND f.cache_status <> 'hit'""")
ORACLES["sequential_logs"] = sql(IN_ORDER, """
SELECT cache_status, CASE WHEN cache_status = 'hit' THEN 3 WHEN n_url THEN 9 ELSE 8 END AS entries,
  count(*) AS records
FROM (SELECT f.cache_status, r.n_profile_url IS NOT NULL AS n_url
      FROM final f JOIN norm r USING (id)) AS counted GROUP BY ALL""")
ORACLES["enrich_with_cache"] = sql(LATER, ENRICHED)
ORACLES["cache_conflict"] = sql(LATER, """
SELECT id, processing_status, CAST(needs_review AS BIGINT) AS needs_review
FROM final WHERE cache_status = 'conflict'""")
ORACLES["cache_upsert"] = sql(LATER, """
SELECT key_type, key_value, write_id AS identity_cache_id
FROM first_writers JOIN writes USING (id)""")
ORACLES["cache_create"] = sql(LATER, """
SELECT write_id AS id, first_name, last_name, email, social_handle, profile_url,
  CAST(confidence_score AS BIGINT) AS confidence_score, confidence_source,
  CAST(0 AS BIGINT) AS verified
FROM final WHERE write_action = 'create'""")
ORACLES["cache_add_keys"] = sql(CACHE + LOOKUP_KEYS, """
SELECT key_type, key_value, identity_cache_id FROM cache_keys
UNION ALL
SELECT key_type, key_value, 'new-' || arg_min(id, row_index)
FROM lookup_keys k
WHERE NOT EXISTS (SELECT 1 FROM cache_keys c
                  WHERE c.key_type = k.key_type AND c.key_value = k.key_value)
GROUP BY key_type, key_value""")

ORACLES["logs_fanout"] = sql(LATER, """
SELECT creator_id, CAST(seq AS BIGINT) AS seq, step, status, detail FROM (
  SELECT id AS creator_id, 1 AS seq, 'normalized' AS step, 'success' AS status, NULL AS detail
  FROM looked
  UNION ALL SELECT id, 2, 'cache_lookup', CASE cache_status WHEN 'hit' THEN 'success'
    WHEN 'conflict' THEN 'failed' ELSE 'skipped' END,
    CASE WHEN cache_status = 'hit' THEN ids[1] END FROM looked
  UNION ALL SELECT id, 3, 'parsed_full_name',
    CASE WHEN id IN (SELECT id FROM c_full) THEN 'success' ELSE 'skipped' END, NULL FROM unhit
  UNION ALL SELECT id, 4, 'parsed_username',
    CASE WHEN id IN (SELECT id FROM c_user) THEN 'success' ELSE 'skipped' END, NULL FROM unhit
  UNION ALL SELECT id, 5, 'parsed_email',
    CASE WHEN id IN (SELECT id FROM c_email) THEN 'success' ELSE 'skipped' END, NULL FROM unhit
  UNION ALL SELECT id, 6, 'scraped_profile_' || platform,
    CASE WHEN NOT has_page THEN 'failed' WHEN id IN (SELECT id FROM c_page) THEN 'success'
      ELSE 'skipped' END, CASE WHEN NOT has_page THEN 'page_not_found' END FROM scraped
  UNION ALL SELECT id, 7, 'confidence_calculated', 'success', CAST(confidence_score AS VARCHAR)
  FROM final WHERE cache_status <> 'hit'
  UNION ALL SELECT id, 8, 'cache_write', CASE WHEN write_id IS NULL THEN 'skipped'
    ELSE 'success' END, write_id FROM final WHERE cache_status <> 'hit'
  UNION ALL SELECT id, 9, 'final_selection', CASE WHEN processing_status = 'failed' THEN 'failed'
    ELSE 'success' END, NULL FROM final
) AS entries""")

ORACLES["profile_snapshots"] = sql(PAGE_CANDS, """
SELECT id AS creator_id, platform, fetched_via, og_title, bio FROM scraped WHERE has_page""")

ORACLES["run_summary"] = sql(RAW, """
SELECT count(*) AS processed, count(*) FILTER (WHERE row_index % 500 = 0) AS failed
FROM raw_import""")

ORACLES["import_stats"] = sql(LATER, """
SELECT import_id, count(*) AS processed, count(*) FILTER (WHERE needs_review) AS needs_review,
  count(*) FILTER (WHERE processing_status = 'cache_hit') AS cache_hits,
  CAST(0 AS BIGINT) AS duplicates
FROM final GROUP BY import_id""")

# --- duplicates and reports ----------------------------------------------------------------

DUPLICATES = RESOLVED + [
    cte("live", "SELECT * FROM res WHERE duplicate_of_creator_id IS NULL"),
    cte("dup_keys", key_rows(
        "live", "import_id, row_index, id, resolved_first_name, resolved_last_name",
        "coalesce(resolved_email, raw_email)", "coalesce(resolved_social_handle, raw_username)",
        "coalesce(resolved_profile_url, raw_profile_url)")),
    cte("dup_groups", """
  SELECT import_id, key_type, key_value, count(*) AS size, arg_min(id, row_index) AS first_creator_id
  FROM dup_keys GROUP BY import_id, key_type, key_value HAVING count(*) > 1"""),
]
ORACLES["duplicate_groups"] = sql(DUPLICATES, """
SELECT import_id, key_type, CASE key_type WHEN 'profile_url' THEN 'profile url' ELSE key_type END
  AS matched_on, key_value, size, first_creator_id FROM dup_groups""")
ORACLES["duplicates"] = sql(DUPLICATES, """
SELECT import_id, key_type, key_value, row_index, id AS creator_id,
  resolved_first_name AS first_name, resolved_last_name AS last_name, size
FROM dup_keys JOIN dup_groups USING (import_id, key_type, key_value)""")

BUCKET = ("CASE WHEN confidence_score >= 90 THEN 'high' WHEN confidence_score >= 70 THEN 'medium' "
          "WHEN confidence_score IS NOT NULL THEN 'low' END")


def label(labels: dict[str, str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in labels.items()) + " END"


ORACLES["confidence_buckets"] = sql(RESOLVED, f"""
SELECT {BUCKET} AS bucket, count(*) AS rows FROM res
WHERE {BUCKET} IN ('high', 'low') GROUP BY 1""")
ORACLES["shown_of_total"] = sql(RESOLVED, f"""
SELECT import_id, count(*) FILTER (WHERE {BUCKET} = 'medium') AS shown, count(*) AS total
FROM res GROUP BY import_id""")
ORACLES["review_list"] = sql(RESOLVED, f"""
SELECT id, coalesce(nullif(concat_ws(' ', resolved_first_name, resolved_last_name), ''), '—') AS name,
  CAST(confidence_score AS VARCHAR) AS confidence_score, {BUCKET} AS bucket,
  coalesce({label(EVIDENCE_LABELS, 'confidence_source')}, '—') AS evidence,
  replace(processing_status, '_', ' ') AS status, CAST(needs_review AS BIGINT) AS needs_review,
  review_status, duplicate_of_creator_id FROM res""")
RESOLVED_FIELDS = ", ".join(f"resolved_{f} AS {f}" for f in FIELDS)
ORACLES["creator_detail"] = sql(RESOLVED, f"""
SELECT id, {RESOLVED_FIELDS}, CAST(confidence_score AS VARCHAR) AS confidence_score,
  confidence_source, processing_status, CAST(needs_review AS BIGINT) AS needs_review,
  review_status, notes, identity_cache_id, duplicate_of_creator_id,
  '2024-01-01 00:00:00.000000' AS created_at, '2024-01-01 00:00:00.000000' AS updated_at
FROM res""")
ORACLES["point_lookup"] = sql(
    RESOLVED + [cte("asked", X.UNMERGE_REQUESTS.format(raw_import="raw_import"))],
    "SELECT id, import_id FROM res WHERE id IN (SELECT creator_id FROM asked)")
ORACLES["import_rows"] = sql(
    RESOLVED, "SELECT id, row_index FROM res WHERE import_id = '3-MEDIUM' ORDER BY row_index")
ORACLES["first_rows"] = sql(RESOLVED, "SELECT id, row_index FROM res ORDER BY row_index LIMIT 20")

ORACLES["creator_timeline"] = sql(LOGS, f"""
SELECT creator_id, 'log' AS section, {moment('created_at')} AS at, CAST(seq AS BIGINT) AS seq,
  step AS label, status, json_extract_string(detail, '$.k') AS k FROM logs
UNION ALL
SELECT creator_id, 'snapshot', {moment('created_at')}, 0, 'generic', 'static',
  json_extract_string(detail, '$.k') FROM logs WHERE step = 'view'""")
ORACLES["latest_log"] = sql(LOGS, f"""
SELECT creator_id, id, {moment('created_at')} AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY created_at DESC, seq DESC) AS n
  FROM logs WHERE step = 'purchase') AS ordered WHERE n = 1""")
ORACLES["latest_per_step"] = sql(LOGS, f"""
SELECT creator_id, step, {moment('created_at')} AS created_at, status, entries FROM (
  SELECT *, row_number() OVER (PARTITION BY creator_id, step ORDER BY created_at DESC, seq DESC) AS n,
    count(*) OVER (PARTITION BY creator_id, step) AS entries FROM logs) AS ordered WHERE n = 1""")

RUN_LOGS = LOGS + [
    cte("users", X.USERS.format(events="events")),
    cte("done", "SELECT DISTINCT creator_id AS id FROM logs WHERE step = 'purchase' "
                "AND created_at < TIMESTAMP '2024-01-05'"),
]
ORACLES["job_progress"] = sql(RUN_LOGS, f"""
SELECT import_id, total_rows, processed_rows, CAST(attempts AS BIGINT) AS attempts,
  last_processed_row_index,
  CASE WHEN processed_rows = total_rows THEN 'completed' WHEN s IS NOT NULL THEN 'running'
       ELSE 'queued' END AS status,
  {moment('s')} AS started_at,
  {moment('CASE WHEN processed_rows = total_rows THEN e END')} AS completed_at
FROM (
  SELECT import_id, count(*) AS total_rows, count(*) FILTER (WHERE runs > 0) AS processed_rows,
    coalesce(sum(runs), 0) AS attempts,
    coalesce(max(row_index) FILTER (WHERE runs > 0), -1) AS last_processed_row_index,
    min(s) AS s, max(e) AS e
  FROM users LEFT JOIN (SELECT creator_id AS id, count(*) FILTER (WHERE step = 'purchase') AS runs,
      min(created_at) AS s, max(created_at) AS e FROM logs GROUP BY 1) AS per_record USING (id)
  GROUP BY import_id) AS counted""")
ORACLES["resume_rows"] = sql(
    RUN_LOGS, "SELECT id, import_id, row_index FROM users WHERE id NOT IN (SELECT id FROM done)")
ORACLES["next_unfinished"] = sql(RUN_LOGS, """
SELECT import_id, min(row_index) AS row_index, arg_min(id, row_index) AS id
FROM users WHERE id NOT IN (SELECT id FROM done) GROUP BY import_id""")
ORACLES["next_pending"] = sql(
    RAW + [cte("items", X.JOB_ITEMS.format(raw_import="raw_import"))], """
SELECT job_id, creator_id, row_index, status, CAST(attempts AS BIGINT) AS attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY row_index) AS n FROM items
  WHERE status IN ('pending', 'failed')) AS ordered WHERE n = 1""")
ORACLES["top_imports"] = sql(IMPORTS, f"""
SELECT id, file_name, row_count, status, {label(IMPORT_STATUS_LABELS, 'status')} AS status_label,
  {label(NEXT_ACTIONS, 'status')} AS next_action, {moment('created_at')} AS created_at
FROM imports ORDER BY imports.created_at DESC, id LIMIT 4""")
ORACLES["top_exports"] = sql(
    [cte("exports", X.EXPORT_HISTORY.format(orders="orders"))], f"""
SELECT id, import_id, export_type, file_name, row_count, {moment('created_at')} AS created_at
FROM exports ORDER BY exports.created_at DESC, id LIMIT 50""")
ORACLES["import_status"] = sql(IMPORTS, """
SELECT id, CASE status WHEN 'uploaded' THEN 'uploaded' WHEN 'mapped' THEN 'processing'
    ELSE 'completed' END AS status,
  CASE WHEN status NOT IN ('uploaded', 'mapped') THEN 'job-' || id END AS job_id,
  CASE WHEN status NOT IN ('uploaded', 'mapped') THEN '2024-01-01 00:00:00.000000' END
    AS completed_at FROM imports""")

# --- review ---------------------------------------------------------------------------------

ORACLES["approve_ignore"] = sql(RESOLVED + ACTIONS + [cte("sent", """
  SELECT seq, CAST(row_index AS VARCHAR) AS id, action FROM actions WHERE action <> 'override'
  UNION ALL SELECT seq + 1000000000, CAST(row_index AS VARCHAR), 'ignore' FROM actions
  WHERE action <> 'override' AND seq % 5 = 0""")], """
SELECT res.id, CASE last WHEN 'approve' THEN 'approved' WHEN 'ignore' THEN 'ignored'
    ELSE review_status END AS review_status,
  coalesce(good, 0) AS logs, coalesce(bad, 0) AS rejects
FROM res LEFT JOIN (
  SELECT id, arg_max(action, seq) FILTER (WHERE action IN ('approve', 'ignore')) AS last,
    count(*) FILTER (WHERE action IN ('approve', 'ignore')) AS good,
    count(*) FILTER (WHERE action NOT IN ('approve', 'ignore')) AS bad
  FROM sent GROUP BY id) AS per_record USING (id)""")

ORACLES["bulk_review"] = sql(RESOLVED + ACTIONS, """
SELECT res.id, CASE WHEN res.needs_review THEN 'approved' ELSE res.review_status END AS review_status,
  CAST(res.needs_review AS BIGINT) AS logs, CAST(res.needs_review AS BIGINT) AS log_ids,
  a.reject_reason
FROM res LEFT JOIN (
  SELECT CAST(row_index AS VARCHAR) AS id,
    CASE WHEN seq % 2 = 0 THEN 'seq_repeated' ELSE 'seq_missing' END AS reject_reason
  FROM actions WHERE action = 'ignore') AS a USING (id)""")

FIELD_CASES = " ".join(
    f"WHEN '{name}' THEN resolved_{column}" for name, column in OVERRIDABLE_FIELDS.items()
)
OVERRIDDEN = RESOLVED + ACTIONS + CACHE + [
    cte("sent", X.OVERRIDES.format(actions="actions")),
    cte("known_fields", "SELECT unnest([" + ", ".join(f"'{n}'" for n in OVERRIDABLE_FIELDS) + "]) AS field"),
    cte("good", """
  SELECT * FROM sent WHERE field IN (SELECT field FROM known_fields) AND trim(value) <> ''"""),
    cte("per_record", "SELECT creator_id, min(seq) AS first_seq, " + ", ".join(
        f"arg_max(value, seq) FILTER (WHERE field = '{n}') AS o_{c}"
        for n, c in OVERRIDABLE_FIELDS.items()) + " FROM good GROUP BY creator_id"),
    cte("hit", """
  SELECT res.*, p.* EXCLUDE (creator_id),
    coalesce(identity_cache_id, sha256('identity|' || id)) AS new_identity
  FROM res JOIN per_record p ON p.creator_id = res.id"""),
    cte("history", f"""
  SELECT g.seq, h.new_identity AS identity_cache_id, g.field, g.value, g.reason,
    CASE WHEN row_number() OVER nth = 1 THEN CASE g.field {FIELD_CASES} END
         ELSE lag(g.value) OVER nth END AS old_value
  FROM good g JOIN hit h ON h.id = g.creator_id
  WINDOW nth AS (PARTITION BY g.creator_id, g.field ORDER BY g.seq)"""),
]
ORACLES["override"] = sql(OVERRIDDEN, f"""
SELECT id, {', '.join(f'coalesce(o_{c}, resolved_{c}) AS {c}' for c in FIELDS)},
  CAST(100 AS BIGINT) AS confidence_score, 'enriched' AS processing_status,
  CAST(0 AS BIGINT) AS needs_review, 'approved' AS review_status, new_identity AS identity_cache_id
FROM hit""")
ORACLES["override_audit"] = sql(OVERRIDDEN, """
SELECT identity_cache_id, field, old_value, value AS new_value, reason, 'local-user' AS created_by
FROM history""")
ORACLES["override_cache"] = sql(OVERRIDDEN + [
    cte("before", """
  SELECT DISTINCT identity_cache_id AS id, 'old' AS first_name, 'old@x' AS email,
    CAST(NULL AS VARCHAR) AS social_handle, CAST(NULL AS INT) AS confidence_score,
    CAST(NULL AS VARCHAR) AS confidence_source
  FROM res WHERE identity_cache_id IS NOT NULL
  UNION ALL
  SELECT new_identity, resolved_first_name, resolved_email, resolved_social_handle,
    coalesce(confidence_score, 0), coalesce(confidence_source, 'manual_override')
  FROM hit WHERE identity_cache_id IS NULL"""),
    cte("changes", "SELECT identity_cache_id AS id, " + ", ".join(
        f"arg_max(value, seq) FILTER (WHERE field = '{n}') AS o_{c}"
        for n, c in OVERRIDABLE_FIELDS.items()) + " FROM history GROUP BY identity_cache_id"),
], """
SELECT b.id, coalesce(o_first_name, first_name) AS first_name, coalesce(o_email, email) AS email,
  coalesce(o_social_handle, social_handle) AS social_handle,
  CAST(confidence_score AS VARCHAR) AS confidence_score, confidence_source,
  CAST(c.id IS NOT NULL AS BIGINT) AS verified
FROM before b LEFT JOIN changes c USING (id)""")
ORACLES["override_keys"] = sql(OVERRIDDEN + [cte("fresh_keys", key_rows(
    "(SELECT * FROM hit WHERE identity_cache_id IS NULL)", "new_identity, first_seq",
    "coalesce(resolved_email, raw_email)", "coalesce(resolved_social_handle, raw_username)",
    "coalesce(resolved_profile_url, raw_profile_url)"))], """
SELECT key_type, key_value, identity_cache_id FROM cache_keys
UNION ALL
SELECT key_type, key_value, arg_min(new_identity, first_seq) FROM fresh_keys k
WHERE NOT EXISTS (SELECT 1 FROM cache_keys c
                  WHERE c.key_type = k.key_type AND c.key_value = k.key_value)
GROUP BY key_type, key_value""")
ORACLES["override_rejects"] = sql(OVERRIDDEN, """
SELECT seq, creator_id, CASE WHEN field NOT IN (SELECT field FROM known_fields)
    THEN 'field_not_editable' ELSE 'value_blank' END AS reject_reason
FROM sent WHERE seq NOT IN (SELECT seq FROM good)""")

MERGED = RESOLVED + [
    cte("pairs", X.MERGE_PAIRS.format(raw_import="raw_import")),
    cte("good", """
  SELECT p.* FROM pairs p JOIN res s ON s.id = source_id JOIN res t ON t.id = target_id
  WHERE source_id <> target_id"""),
    cte("merged", "SELECT s.id, " + ", ".join(
        f"CASE WHEN t.id IS NULL THEN s.resolved_{c} ELSE t.resolved_{c} END AS {c}" for c in FIELDS)
        + """,
    CASE WHEN t.id IS NULL THEN s.confidence_score ELSE coalesce(t.confidence_score, 0) END
      AS confidence_score,
    CASE WHEN t.id IS NULL THEN s.confidence_source ELSE t.confidence_source END AS confidence_source,
    CASE WHEN t.id IS NULL THEN s.processing_status ELSE t.processing_status END AS processing_status,
    t.id IS NULL AND s.needs_review AS needs_review,
    CASE WHEN t.id IS NULL THEN s.review_status ELSE 'approved' END AS review_status,
    coalesce(t.identity_cache_id, s.identity_cache_id) AS identity_cache_id,
    coalesce(t.id, s.duplicate_of_creator_id) AS duplicate_of_creator_id, t.id AS into_id
  FROM res s LEFT JOIN good g ON g.source_id = s.id LEFT JOIN res t ON t.id = g.target_id"""),
]
STATE = f"""id, {IDENTITY}, CAST(confidence_score AS VARCHAR) AS confidence_score,
  confidence_source, processing_status, CAST(needs_review AS BIGINT) AS needs_review,
  review_status, identity_cache_id, duplicate_of_creator_id"""
ORACLES["merge"] = sql(MERGED, f"SELECT {STATE} FROM merged")
IN_CHAIN = "OVER (PARTITION BY import_id, row_index - row_index % 1000 ORDER BY row_index)"
ORACLES["merge_chains"] = sql(RESOLVED + [cte("chained", f"""
  SELECT *, first_value(id) {IN_CHAIN} AS head, lag(id) {IN_CHAIN} AS target,
    first_value(identity_cache_id IGNORE NULLS) {IN_CHAIN} AS link
  FROM res""")] + [cte("merged", "SELECT s.id, " + ", ".join(
    f"h.resolved_{c} AS {c}" for c in FIELDS) + """,
    CASE WHEN s.target IS NULL THEN s.confidence_score ELSE coalesce(h.confidence_score, 0) END
      AS confidence_score, h.confidence_source, h.processing_status,
    s.target IS NULL AND s.needs_review AS needs_review,
    CASE WHEN s.target IS NULL THEN s.review_status ELSE 'approved' END AS review_status,
    s.link AS identity_cache_id, coalesce(s.target, s.duplicate_of_creator_id) AS duplicate_of_creator_id
  FROM chained s JOIN res h ON h.id = s.head""")], f"SELECT {STATE} FROM merged")
ORACLES["merge_logs"] = sql(MERGED, """
SELECT source_id AS creator_id, 'merged_duplicate' AS step, target_id AS target,
  resolved_first_name AS first_name, CAST(coalesce(confidence_score, 0) AS VARCHAR) AS score,
  review_status
FROM good JOIN res ON res.id = source_id""")
ORACLES["merge_rejects"] = sql(MERGED, """
SELECT seq, source_id, target_id, CASE WHEN source_id = target_id
    THEN 'target_is_source' ELSE 'no_such_target' END AS reject_reason
FROM pairs WHERE seq NOT IN (SELECT seq FROM good)""")
UNMERGED = MERGED + [cte("asked", X.UNMERGE_REQUESTS.format(raw_import="raw_import"))]
ORACLES["unmerge"] = sql(UNMERGED + [cte("back", "SELECT s.id, " + ", ".join(
    f"CASE WHEN u THEN s.resolved_{c} ELSE m.{c} END AS {c}" for c in FIELDS) + """,
    CASE WHEN u THEN coalesce(s.confidence_score, 0) ELSE m.confidence_score END AS confidence_score,
    CASE WHEN u THEN s.confidence_source ELSE m.confidence_source END AS confidence_source,
    CASE WHEN u THEN s.processing_status ELSE m.processing_status END AS processing_status,
    CASE WHEN u THEN s.needs_review ELSE m.needs_review END AS needs_review,
    CASE WHEN u THEN s.review_status ELSE m.review_status END AS review_status,
    CASE WHEN u THEN coalesce(s.identity_cache_id, m.identity_cache_id) ELSE m.identity_cache_id
      END AS identity_cache_id,
    CASE WHEN u THEN NULL ELSE m.duplicate_of_creator_id END AS duplicate_of_creator_id
  FROM res s JOIN (SELECT *, into_id IS NOT NULL AND id IN (SELECT creator_id FROM asked) AS u
                   FROM merged) m USING (id)""")], f"SELECT {STATE} FROM back")
ORACLES["unmerge_rejects"] = sql(UNMERGED, """
SELECT a.seq, a.creator_id, CASE WHEN m.id IS NULL THEN 'no_such_record'
    WHEN m.duplicate_of_creator_id IS NULL THEN 'not_merged'
    ELSE 'no_merge_on_record' END AS reject_reason
FROM asked a LEFT JOIN merged m ON m.id = a.creator_id
WHERE m.into_id IS NULL""")

# --- export and integrity ------------------------------------------------------------------

EXPORTABLE = "review_status <> 'ignored' AND duplicate_of_creator_id IS NULL"
ORACLES["export_quick"] = sql(RESOLVED, f"""
SELECT resolved_first_name AS "firstName", resolved_email AS "email",
  resolved_social_handle AS "socialHandle" FROM res WHERE {EXPORTABLE}""")
ORACLES["export_full"] = sql(RESOLVED, f"""
SELECT resolved_first_name AS "firstName", resolved_email AS "email",
  resolved_social_handle AS "socialHandle", resolved_last_name AS "lastName",
  resolved_display_name AS "displayName", resolved_platform AS "platform",
  resolved_profile_url AS "profileUrl", CAST(confidence_score AS VARCHAR) AS "confidenceScore",
  confidence_source AS "confidenceSource", processing_status AS "processingStatus",
  CAST(needs_review AS BIGINT) AS "needsReview", review_status AS "reviewStatus",
  pipeline_version AS "pipelineVersion", CAST(1700000000000 AS BIGINT) AS "exportedAt",
  notes AS "notes" FROM res WHERE {EXPORTABLE}""")
ORACLES["export_csv"] = sql(RESOLVED, f"""
SELECT 'row' AS part, coalesce(resolved_first_name, '') AS a, coalesce(resolved_email, '') AS b,
  coalesce(resolved_social_handle, '') AS c FROM res WHERE import_id = '2-HIGH' AND {EXPORTABLE}
UNION ALL
SELECT 'history', 'export-quick-2-HIGH-1700000000000.csv', 'quick', CAST(count(*) AS VARCHAR)
FROM res WHERE import_id = '2-HIGH' AND {EXPORTABLE}""")
ORACLES["export_one_file"] = sql(RESOLVED, f"""
SELECT row_number() OVER (ORDER BY row_index) - 1 AS place, coalesce(resolved_first_name, '') AS a,
  coalesce(resolved_email, '') AS b, coalesce(resolved_social_handle, '') AS c
FROM res WHERE import_id = '2-HIGH' AND {EXPORTABLE}""")

LEFT = RESOLVED + IMPORTS + [
    cte("kept", "SELECT * FROM res WHERE import_id NOT IN ('2-HIGH', '5-LOW')"),
    cte("exports", X.EXPORT_HISTORY.format(orders="orders")),
]
ORACLES["cascade_delete"] = sql(LEFT, """
SELECT 'imports' AS t, id FROM imports WHERE id NOT IN ('2-HIGH', '5-LOW')
UNION ALL SELECT 'creators', id FROM kept UNION ALL SELECT 'logs', id FROM kept""")
ORACLES["set_null"] = sql(LEFT, """
SELECT 'creators' AS t, id, CASE WHEN duplicate_of_creator_id IN (SELECT id FROM res
    WHERE import_id IN ('2-HIGH', '5-LOW')) THEN NULL ELSE duplicate_of_creator_id END AS link
FROM kept
UNION ALL
SELECT 'exports', id, CASE WHEN import_id NOT IN ('2-HIGH', '5-LOW') THEN import_id END
FROM exports""")
ORACLES["delete_identities"] = sql(RESOLVED + CACHE + [cte("gone", """
  SELECT DISTINCT identity_cache_id AS id FROM res WHERE identity_cache_id LIKE '%7%'
  UNION ALL SELECT id FROM cache WHERE id LIKE '%blue%'""")], """
SELECT 'cache' AS t, id, '' AS link FROM cache WHERE id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'keys', key_type || ':' || key_value, identity_cache_id FROM cache_keys
WHERE identity_cache_id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'creators', id, CASE WHEN identity_cache_id IN (SELECT id FROM gone) THEN NULL
    ELSE identity_cache_id END FROM res""")
