"""Pick exactly one candidate by tiers of evidence.

The tiers are nested fallbacks: plausible names before implausible ones, real
evidence before last resorts (e-mail, ``@handle``), dictionary-confirmed before
unconfirmed, then confidence, then position. A tier that would leave nothing is
skipped, which makes the whole rule one sort key and the winner one maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import DEFAULT_WEIGHTS, PIPELINE_VERSION, Weights
from personae.functions.text import js_trim, title_case_if_shouty
from personae.schema import RESOLVED


def is_plausible(c: Column) -> Column:
    name = js_trim(F.coalesce(c["first_name"], c["display_name"], F.lit("")))
    return ~c["business_like"] & (F.length(name) >= 2) & name.rlike("[a-zA-Z]")


def is_last_resort(c: Column) -> Column:
    return (c["source"] == "email") | c["handle_fallback"]


def is_verified(c: Column) -> Column:
    return ~c["handle_fallback"] & ((c["source"] == "full_name") | c["known_name"])


def rank_key(c: Column, position: Column) -> list[Column]:
    return [
        is_plausible(c).alias("plausible"),
        (~is_last_resort(c)).alias("evidence"),
        is_verified(c).alias("verified"),
        c["confidence"].alias("confidence"),
        (-position).alias("earlier"),
    ]


def ranked(c: Column, position: Column) -> Column:
    """Candidate behind its sort key; NULL for an absent candidate."""
    return F.when(c.isNotNull(), F.struct(*rank_key(c, position), c.alias("candidate")))


def winner(candidates: Column) -> Column:
    """The strongest candidate of an array, NULL for an empty array."""
    return F.array_max(F.transform(candidates, ranked))["candidate"]


def _best_of(candidates: list[str]) -> Column:
    """Position of the strongest of several candidate columns (the earlier one on a full tie)."""
    keys = [
        F.when(F.col(c).isNotNull(), F.struct(*rank_key(F.col(c), F.lit(i))))
        for i, c in enumerate(candidates)
    ]
    best = F.greatest(*keys) if len(keys) > 1 else keys[0]
    return -best["earlier"]


def _at(position: Column, candidates: list[str]) -> Column:
    return F.coalesce(*[F.when(position == i, F.col(c)) for i, c in enumerate(candidates)])


def score(
    df: DataFrame, candidates: str | list[str] = "candidates", weights: Weights = DEFAULT_WEIGHTS,
    version: str = PIPELINE_VERSION,
) -> DataFrame:
    """Add w_* identity columns and the status the evidence earns.

    ``candidates`` is an array column, or the names of single candidate columns.
    """
    if isinstance(candidates, str):
        df = df.withColumn("_winner", winner(F.col(candidates)))
    else:
        # the keys alone are compared, and only the winner is copied
        df = df.withColumn("_best", _best_of(candidates))
        df = df.withColumn("_winner", _at(F.col("_best"), candidates)).drop("_best")
    w = F.col("_winner")
    needs_review = w["ambiguous"] | (w["confidence"] < weights.review_threshold)
    return (
        df.withColumns(
            {
                "w_first_name": title_case_if_shouty(w["first_name"]),
                "w_last_name": title_case_if_shouty(w["last_name"]),
                "w_display_name": w["display_name"],
                "w_platform": w["platform"],
                "w_profile_url": w["profile_url"],
                "w_email": w["email"],
                "w_social_handle": w["social_handle"],
                "w_confidence_score": F.coalesce(w["confidence"], F.lit(0)),
                "w_confidence_source": w["source"],
                "w_processing_status": F.when(w.isNull(), "failed")
                .when(needs_review, "needs_review")
                .otherwise("enriched"),
                "w_needs_review": F.coalesce(needs_review, F.lit(True)),
                "w_pipeline_version": F.lit(version),
            }
        )
        .drop("_winner")
    )


def fill_from_input(df: DataFrame) -> DataFrame:
    """resolved_* = the winner's fields, else the record's own normalized input."""
    fallback = {
        "platform": "n_platform",
        "profile_url": "n_profile_url",
        "email": "n_email",
        "social_handle": "n_username",
    }
    return df.withColumns(
        {
            f"resolved_{f}": F.coalesce(F.col(f"w_{f}"), F.col(fallback[f]))
            if f in fallback
            else F.col(f"w_{f}")
            for f in RESOLVED
        }
    )


def demote_conflicts(status: Column, conflict: Column) -> Column:
    """A cache conflict sends any usable result to review."""
    return F.when(conflict & (status != "failed"), "needs_review").otherwise(status)
