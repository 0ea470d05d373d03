"""Already-fetched profile pages as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personae.config import MIN_USABLE_HTML
from personae.functions.text import utf16_length
from personae.operators.scale import HOT_ROWS, skew_join


def usable_pages(
    static: DataFrame, browser: DataFrame | None = None, min_length: int = MIN_USABLE_HTML,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(url, html, fetched_via): static pages that are long enough, else browser ones.

    A short static page is a script shell or a consent wall; its URL falls back
    to the browser table, whatever the length there. Any URL may hold many of its rows.
    """
    # characters first: only pages just below the limit need a look at their encoding
    long = (F.length("html") >= min_length) | (utf16_length(F.col("html")) >= min_length)
    good = static.where(long).select(
        "url", "html", F.lit("static").alias("fetched_via")
    )
    if browser is None:
        return good
    pages = browser.select("url", "html", F.lit("browser").alias("fetched_via"))
    there = good.select("url").distinct()
    rest = skew_join(pages, there, ["url"], ["url", "html"], "left_anti", hot_rows)
    return good.unionByName(rest.select("url", "html", "fetched_via"))
