"""Raw columns to normalized n_* columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personae.config import DEFAULT_DESCRIPTORS, Descriptors
from personae.functions import text as T


def normalize_records(
    df: DataFrame, descriptors: Descriptors = DEFAULT_DESCRIPTORS
) -> DataFrame:
    """Add n_full_name, n_username, n_email, n_profile_url and n_platform."""
    df = T.with_clean_names(df, {"n_full_name": "raw_full_name"}, descriptors)
    return df.withColumns(
        {
            "n_username": T.blank_to_null(
                F.regexp_replace(T.collapse_whitespace(F.col("raw_username")), "^@", "")
            ),
            "n_email": T.blank_to_null(F.lower(T.collapse_whitespace(F.col("raw_email")))),
            "n_profile_url": T.blank_to_null(T.collapse_whitespace(F.col("raw_profile_url"))),
            "n_platform": T.blank_to_null(T.collapse_whitespace(F.col("raw_platform"))),
        }
    )
