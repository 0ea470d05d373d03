"""Profile pages: page fields, per-platform profile, candidate and snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import (
    DEFAULT_DESCRIPTORS,
    DEFAULT_WEIGHTS,
    Descriptors,
    PLATFORMS,
    SOURCE_BY_PLATFORM,
    Weights,
)
from personae.functions import text as T
from personae.functions.html import markup, meta_content, meta_tags, page_title
from personae.functions.keys import fetch_key, platform_of_host, url_host
from personae.operators.dictionary import NameDictionary
from personae.operators.extract import CANDIDATE_TYPE, candidate
from personae.operators.scale import HOT_ROWS, skew_join


def page_fields(pages: DataFrame) -> DataFrame:
    """Add og_title, og_description and title to a table with an ``html`` column."""
    return (
        pages.withColumn("_markup", markup(F.col("html")))
        .withColumn("_tags", meta_tags(F.col("_markup")))
        .withColumns(
            {
                "og_title": meta_content(F.col("_tags"), "og:title"),
                "og_description": meta_content(F.col("_tags"), "og:description"),
                "title": page_title(F.col("_markup")),
            }
        )
        .drop("_markup", "_tags")
    )


# --- platform registry ---------------------------------------------------------


def handle_in_url(url: Column, pattern: str) -> Column:
    return T.blank_to_null(F.regexp_extract(url, pattern, 1))


def _name_before_handle(og_title: Column) -> Column:
    return T.blank_to_null(T.js_trim(F.substring_index(og_title, "(@", 1)))


def instagram_profile(url: Column) -> tuple[Column, Column]:
    return (
        _name_before_handle(F.col("og_title")),
        handle_in_url(url, r"(?i)instagram\.com/([^/?#]+)"),
    )


def tiktok_profile(url: Column) -> tuple[Column, Column]:
    return (
        _name_before_handle(F.col("og_title")),
        handle_in_url(url, r"(?i)tiktok\.com/@([^/?#]+)"),
    )


def generic_profile(url: Column) -> tuple[Column, Column]:
    name = T.js_trim(F.coalesce(T.blank_to_null(F.col("og_title")), F.col("title")))
    return T.blank_to_null(name), F.lit(None).cast("string")


# platform -> (url column) -> (display name, handle); the page columns og_title,
# og_description and title are in scope. Extend by adding entries.
ADAPTERS: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "instagram": instagram_profile,
    "tiktok": tiktok_profile,
    "facebook": generic_profile,
    "youtube": generic_profile,
    "generic": generic_profile,
}
# what a record gets from its page, beside ``has_page``
PAGE_FIELDS = ["og_title", "og_description", "title", "fetched_via"]
# platforms whose snapshot also records the <title>
TITLE_SNAPSHOT = {"facebook", "youtube", "generic"}


def _by_platform(platform: Column, choices: dict[str, Column]) -> Column:
    out = choices["generic"]
    for name, value in choices.items():
        if name != "generic":
            out = F.when(platform == name, value).otherwise(out)
    return out


def is_placeholder_title(title: Column, platform: Column) -> Column:
    """The site's own name or a login wall instead of a profile."""
    shown = F.lower(T.js_trim(title))
    own_name = platform.isin(PLATFORMS[:-1]) & (shown == platform)
    word, end = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    wall = shown.rlike(
        rf"{word}(?:log{T.WS}*in|log{T.WS}*into|sign{T.WS}*up|sign{T.WS}*in){end}"
    )
    return title.isNull() | (shown == "") | own_name | wall


# --- pages joined to records ---------------------------------------------------


def attach_pages(
    df: DataFrame, pages: DataFrame | None, url: str = "n_profile_url", row_id: str = "id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join the fields of the page that was fetched for each record's URL.

    Pages are looked up by ``fetch_key``, query included: what identifies a person may
    drop a query, what was fetched may not. Of several pages the one with exactly the
    record's URL wins, then a static one, then one with a title. ``pages`` (url, html,
    fetched_via) is reduced to its fields before the join, so no html is shuffled.
    """
    fields = PAGE_FIELDS
    if pages is None:
        return df.withColumns(
            {f: F.lit(None).cast("string") for f in fields} | {"has_page": F.lit(False)}
        )
    untitled = F.coalesce("og_title", "title").isNull()
    by_worth = F.struct(
        (F.col("fetched_via") != "static").alias("_late"), untitled.alias("_untitled"),
        T.js_trim(F.col("url")).alias("_spelled"), *fields,
    )
    slim = page_fields(pages).select(
        fetch_key(F.col("url")).alias("_url"), T.js_trim(F.col("url")).alias("_spelled"),
        by_worth.alias("_page"),
    )
    # a handful of spellings per key
    one = (
        slim.groupBy("_url", "_spelled").agg(F.min("_page").alias("_page"))
        .groupBy("_url").agg(
            F.min("_page").alias("_best"),
            F.map_from_entries(F.collect_list(F.struct("_spelled", "_page"))).alias("_exact"),
        )
    )
    keyed = df.withColumn("_url", T.blank_to_null(fetch_key(F.col(url))))
    joined = skew_join(keyed, one, ["_url"], row_id, "left", hot_rows).withColumn(
        "_page", F.coalesce(F.element_at("_exact", T.js_trim(F.col(url))), "_best")
    )
    return joined.withColumns(
        {f: F.col(f"_page.{f}") for f in fields} | {"has_page": F.col("_page").isNotNull()}
    ).drop("_url", "_best", "_exact", "_page")


def with_profile_candidate(
    df: DataFrame, dictionary: NameDictionary, url: str = "n_profile_url",
    out: str = "cand_profile", row_id: str = "id", weights: Weights = DEFAULT_WEIGHTS,
    descriptors: Descriptors = DEFAULT_DESCRIPTORS,
) -> DataFrame:
    """Scrape outcome per record: platform, candidate, snapshot and error.

    Needs the columns of ``attach_pages``. A record with a URL but without a page
    gets the error ``page_not_found``; nothing raises.
    """
    link, platform = F.col(url), F.col("scrape_platform")
    df = df.withColumn("_host", url_host(link)).withColumn(
        "scrape_platform", F.when(link.isNotNull(), platform_of_host(F.col("_host")))
    ).drop("_host")
    parts = {name: adapter(link) for name, adapter in ADAPTERS.items()}
    df = df.withColumns(
        {
            "_shown": F.when(
                F.col("has_page"), _by_platform(platform, {k: v[0] for k, v in parts.items()})
            ),
            "_handle": F.when(
                F.col("has_page"), _by_platform(platform, {k: v[1] for k, v in parts.items()})
            ),
        }
    )
    shown, handle, name = F.col("_shown"), F.col("_handle"), F.col("_name")
    df = T.with_clean_names(df, {"_name": "_shown"}, descriptors)
    df = df.withColumn("_split", T.words(name)).withColumns(
        {"_first": T.first_of(F.col("_split")), "_last": T.last_of(F.col("_split"))}
    )
    df = dictionary.flag(df, {"_first_known": "_first", "_last_known": "_last"}, row_id)
    source = _by_platform(platform, {p: F.lit(s) for p, s in SOURCE_BY_PLATFORM.items()})
    confidence = _by_platform(
        platform, {p: F.lit(getattr(weights, s)) for p, s in SOURCE_BY_PLATFORM.items()}
    )
    unnamed = name.isNull()
    business = T.contains_descriptor(
        T.fold_unicode(T.strip_bio_tags(shown)), descriptors
    )
    built = candidate(
        source,
        first_name=F.when(unnamed, F.concat(F.lit("@"), handle)).otherwise(F.col("_first")),
        last_name=F.col("_last"),
        display_name=name,
        platform=platform,
        profile_url=link,
        social_handle=handle,
        confidence=confidence,
        business_like=~unnamed & business,
        handle_fallback=unnamed,
        known_name=F.col("_first_known") | F.col("_last_known"),
        meta=F.to_json(
            F.struct(
                handle.alias("username"),
                F.col("og_description").alias("bio"),
                F.lit(True).alias("scraped"),
                F.when(unnamed, True).alias("isHandleFallback"),
                F.when(~unnamed, business).alias("businessLike"),
            )
        ),
    )
    usable = F.col("has_page") & F.when(unnamed, handle.isNotNull()).otherwise(
        ~is_placeholder_title(name, platform)
    )
    snapshot = F.when(
        platform.isin(*TITLE_SNAPSHOT),
        F.to_json(
            F.struct(
                F.col("og_title").alias("ogTitle"), F.col("title"),
                F.col("og_description").alias("bio"),
            ),
            {"ignoreNullFields": "false"},
        ),
    ).otherwise(
        F.to_json(
            F.struct(
                F.col("og_title").alias("ogTitle"), F.col("og_description").alias("bio")
            ),
            {"ignoreNullFields": "false"},
        )
    )
    return df.withColumns(
        {
            out: F.when(usable, built).otherwise(F.lit(None).cast(CANDIDATE_TYPE)),
            "scrape_error": F.when(link.isNotNull() & ~F.col("has_page"), "page_not_found"),
            "raw_snapshot": F.when(F.col("has_page"), snapshot),
        }
    ).drop("_shown", "_handle", "_name", "_split", "_first", "_last", "_first_known",
           "_last_known")
