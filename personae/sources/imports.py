"""CSV imports: file routing, scan, ingest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from personae.operators.scale import dense_index, index_placed, materialize
from personae.schema import CREATORS, IMPORT_HISTORY, conform, empty, new_creators
from personae.sources import records


def file_type(name: Column) -> Column:
    """csv, xlsx, or NULL for a file no reader takes."""
    lower = F.lower(name)
    return F.when(lower.endswith(".csv"), "csv").when(
        lower.endswith(".xlsx") | lower.endswith(".xls"), "xlsx"
    )


def route_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a table with ``file_name`` into readable CSV files and rejects.

    Workbooks are recognized but not read here: convert them to CSV upstream.
    """
    typed = files.withColumn("file_type", file_type(F.col("file_name")))
    reason = F.when(
        F.col("file_type").isNull(), "file_type_unknown"
    ).when(F.col("file_type") == "xlsx", "workbook")
    routed = typed.withColumn("reject_reason", reason)
    return (
        routed.where("reject_reason IS NULL").drop("reject_reason"),
        routed.where("reject_reason IS NOT NULL"),
    )


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Header cells as names of their own; a taken name gets the next free suffix."""
    taken: set[str] = set()
    out = []
    for raw in names:
        name = (raw or "").removeprefix("\ufeff")
        free, n = name, 0
        while free in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free)
        out.append(free)
    return out


SURPLUS = "__parsed_extra"


@dataclass
class Sheet:
    """Rows as arrays: ``cells`` by position of the header, and what lies beyond it.

    Also the place of each row: ``file``, ``block`` and ``pos`` within the block.
    """

    headers: list[str]
    rows: DataFrame | None
    rejects: DataFrame

    def named(self) -> DataFrame:
        """A column for each header; needs headers that differ in more than case."""
        return self.rows.select(
            *[F.col("cells")[i].alias(h) for i, h in enumerate(self.headers)]
        )


REJECTS = "file string, line long, raw string, reason string, kept boolean"


def read_csv(spark: SparkSession, path: str) -> Sheet:
    """All cells as strings, empty lines skipped, '' for an empty or missing cell.

    Delimiter and names are taken from the header record. Files are split however many lines
    their records have (see ``records``). ``rejects`` tells what could not be read: the lines
    of a record whose quote is never closed or that is too long (reasons ``unclosed_quote``,
    ``record_too_long``) are no rows, a line that is not UTF-8 (``bad_encoding``) is kept with
    replacement characters.
    """
    found = records.scan(spark, path)
    if found is None:
        return Sheet([], None, spark.createDataFrame([], REJECTS))
    headers = unique_headers(found.headers)
    n = len(headers)
    cells = F.col("all")
    rows = found.rows.withColumn("all", records.Grammar(found.sep).cells(F.col("record")))
    # by position: header names may differ by case only, or begin with an underscore
    return Sheet(headers, rows.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(cells, i), F.lit(""))
        ).alias("cells"),
        F.when(F.size(cells) > n, F.slice(cells, F.lit(n + 1), F.size(cells))).alias("surplus"),
        "file", "block", "pos",
    ), found.rejects)


def cells_payload(headers: Sequence[str]) -> Column:
    """``cells`` and ``surplus`` of a sheet as one JSON object, in the order of the file."""
    named = F.to_json(F.struct(*[F.col("cells")[i].alias(h) for i, h in enumerate(headers)]))
    extra = F.concat(
        F.substring(named, F.lit(1), F.length(named) - 1), F.lit(f',"{SURPLUS}":'),
        F.to_json("surplus"), F.lit("}"),
    )
    return F.when(F.col("surplus").isNull(), named).otherwise(extra)


def payload(columns: Sequence[str]) -> Column:
    """The row as it was in the file, as one JSON object."""
    return F.to_json(
        F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]), {"ignoreNullFields": "false"}
    )


@dataclass
class Ingested:
    creators: DataFrame
    import_history: DataFrame
    headers: list[str]
    rejects: DataFrame


def ingest_csv(
    spark: SparkSession, path: str, import_id: str, now: Column, file_name: str | None = None,
) -> Ingested:
    """Read one import (a file, or a folder of part files with the same header).

    Rows are numbered in file order from their position inside each split, so no
    global sort is needed; the scan is stored once because the numbers depend on it.
    """
    sheet = read_csv(spark, path)
    headers = sheet.headers
    if sheet.rows is None:
        creators = empty(spark, CREATORS)
    else:
        placed = sheet.rows.select(
            F.lit(import_id).alias("import_id"), cells_payload(headers).alias("raw_payload"),
            "file", "block", "pos",
        )
        stored = materialize(placed, "ingest")
        creators = new_creators(
            index_placed(stored, ["import_id"], ["file", "block"], "pos", "row_index"), now
        )
    history = creators.groupBy().agg(F.count("*").alias("row_count")).select(
        F.lit(import_id).alias("id"), F.lit(file_name or path.rsplit("/", 1)[-1])
        .alias("file_name"),
        F.lit("csv").alias("file_type"), "row_count", F.lit("uploaded").alias("status"),
        now.alias("created_at"),
    )
    return Ingested(creators, conform(history, IMPORT_HISTORY), headers, sheet.rejects)


def ingest_table(
    rows: DataFrame, import_id: str, order: Sequence[str], columns: Sequence[str], now: Column
) -> DataFrame:
    """Ingest rows of an existing table: number them per import in ``order``."""
    kept = rows.select(
        F.col(import_id).alias("import_id"), payload(columns).alias("raw_payload"), *order
    )
    return new_creators(dense_index(kept, ["import_id"], order, "row_index", "ingest"), now)
