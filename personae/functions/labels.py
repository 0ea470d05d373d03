"""Reviewer-facing buckets, labels and next actions."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import EVIDENCE_LABELS, IMPORT_STATUS_LABELS, NEXT_ACTIONS
from personae.functions.text import blank_to_null


def confidence_bucket(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= 90, "high")
        .when(score >= 70, "medium")
        .otherwise("low")
    )


def filter_buckets(df: DataFrame, selected: Iterable[str], score: str = "confidence_score"
                   ) -> DataFrame:
    """Keep the selected buckets; an empty selection keeps everything."""
    chosen = list(selected)
    return df.where(confidence_bucket(F.col(score)).isin(chosen)) if chosen else df


def display_name(first: Column, last: Column) -> Column:
    joined = F.concat_ws(" ", blank_to_null(first), blank_to_null(last))
    return F.coalesce(blank_to_null(joined), F.lit("—"))


def _lookup(labels: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*labels.items())]), c)


def evidence_label(source: Column) -> Column:
    return F.coalesce(_lookup(EVIDENCE_LABELS, source), F.lit("—"))


def status_label(status: Column) -> Column:
    return F.replace(status, F.lit("_"), F.lit(" "))


def import_status_label(status: Column) -> Column:
    return _lookup(IMPORT_STATUS_LABELS, status)


def key_type_label(key_type: Column) -> Column:
    """Only the first underscore becomes a space."""
    return F.regexp_replace(key_type, "^([^_]*)_", "$1 ")


def next_action(status: Column) -> Column:
    return _lookup(NEXT_ACTIONS, status)
