"""Headers to canonical fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from personae.config import COLUMN_ALIASES, PREVIEW_ROWS, RAW_COLUMNS
from personae.functions.text import blank_to_null, js_trim, normalize_header
from personae.operators.normalize import normalize_records
from personae.schema import literal_table

ColumnMapping = dict[str, str]


def alias_table(spark: SparkSession, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES
                ) -> DataFrame:
    rows = [
        (field, pos, alias)
        for pos, (field, names) in enumerate(aliases.items())
        for alias in names
    ]
    return literal_table(spark, rows, ["field", "field_pos", "alias"])


def suggest_mapping(headers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(header, field) for the headers that spell a known alias.

    ``headers`` has a ``header`` column. Exact match after normalization; the
    first field of the alias table wins.
    """
    table = alias_table(headers.sparkSession) if aliases is None else aliases
    # a handful of configured spellings, whatever the number of headers
    known = F.broadcast(
        table.groupBy(normalize_header(F.col("alias")).alias("_key")).agg(
            F.min_by("field", "field_pos").alias("field")
        )
    )
    return (
        headers.withColumn("_key", normalize_header(F.col("header")))
        .join(known, "_key")
        .select("header", "field")
    )


def suggested_mapping(
    spark: SparkSession, headers: Sequence[str],
    aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES,
) -> ColumnMapping:
    """Mapping of one file's header line, in header order."""
    table = literal_table(spark, [(h,) for h in headers], ["header"])
    known = suggest_mapping(table, alias_table(spark, aliases))
    found = {r.header: r.field for r in known.collect()}
    return {h: found[h] for h in headers if h in found}


def edit_mapping(suggested: ColumnMapping, edits: Mapping[str, str | None]) -> ColumnMapping:
    """Reassign headers; an empty field drops the header."""
    merged = {**suggested, **edits}
    return {header: field for header, field in merged.items() if field}


def mapped_columns(mapping: ColumnMapping, value_of) -> dict[str, Column]:
    """raw_* columns: the first non-blank value among a field's headers."""
    out = {}
    for field, column in RAW_COLUMNS.items():
        values = [
            blank_to_null(js_trim(value_of(h))) for h, f in mapping.items() if f == field
        ]
        out[column] = F.coalesce(*values) if values else F.lit(None).cast("string")
    return out


def apply_mapping(rows: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """Map a wide table whose columns are the file's headers."""
    return rows.withColumns(mapped_columns(mapping, lambda h: F.col(f"`{h}`")))


def apply_mapping_to_payload(creators: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """Map ingested rows from the raw_payload JSON kept with each of them."""
    payload = F.from_json("raw_payload", "map<string,string>")
    parsed = creators.withColumn("_payload", payload)
    columns = mapped_columns(mapping, lambda h: F.try_element_at("_payload", F.lit(h)))
    return parsed.withColumns(columns).drop("_payload")


def confirm_mapping(
    creators: DataFrame, imports: DataFrame, import_id: str, mapping: ColumnMapping,
    now: Column,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill raw_* of one import: (its creators, all imports, normalized preview)."""
    rows = apply_mapping_to_payload(creators.where(F.col("import_id") == import_id), mapping)
    rows = rows.withColumn("updated_at", now)
    counted = rows.groupBy(F.col("import_id").alias("id")).agg(F.count("*").alias("_rows"))
    as_json = F.to_json(
        F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        if mapping else F.from_json(F.lit("{}"), "map<string,string>")
    )
    this = F.col("id") == import_id
    updated = imports.join(counted, "id", "left").withColumns(
        {
            "column_mapping": F.when(this, as_json).otherwise(F.col("column_mapping")),
            "row_count": F.when(this, F.coalesce("_rows", F.lit(0)))
            .otherwise(F.col("row_count")),
            "status": F.when(this, "mapped").otherwise(F.col("status")),
        }
    ).select(*imports.columns)
    preview = normalize_records(rows.orderBy("row_index").limit(PREVIEW_ROWS)).select(
        "row_index", "n_full_name", "n_username", "n_email", "n_profile_url", "n_platform"
    )
    return rows, updated, preview
