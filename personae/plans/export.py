"""Clean lists out of reviewed imports."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from personae.operators.scale import drop_folder
from personae.schema import EXPORT_HISTORY, conform

FULL_COLUMNS: dict[str, str] = {
    "firstName": "resolved_first_name",
    "email": "resolved_email",
    "socialHandle": "resolved_social_handle",
    "lastName": "resolved_last_name",
    "displayName": "resolved_display_name",
    "platform": "resolved_platform",
    "profileUrl": "resolved_profile_url",
    "confidenceScore": "confidence_score",
    "confidenceSource": "confidence_source",
    "processingStatus": "processing_status",
    "needsReview": "needs_review",
    "reviewStatus": "review_status",
    "pipelineVersion": "pipeline_version",
    "exportedAt": "",
    "notes": "notes",
}
# quotes doubled inside quotes, values written as they are, nothing for an absent value
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
QUICK_COLUMNS = ["firstName", "email", "socialHandle"]
# bytes that a task holds of a part while it puts it into the one file
COPY_BYTES = 8 << 20


def exportable(creators: DataFrame) -> DataFrame:
    """Not ignored by a reviewer and not merged into another record."""
    return creators.where(
        (F.col("review_status") != "ignored") & F.col("duplicate_of_creator_id").isNull()
    )


def quick_rows(creators: DataFrame) -> DataFrame:
    return creators.select(*[F.col(FULL_COLUMNS[c]).alias(c) for c in QUICK_COLUMNS])


def full_rows(creators: DataFrame, exported_at_ms: int) -> DataFrame:
    return creators.select(
        *[
            (F.col(source) if source else F.lit(exported_at_ms).cast("bigint")).alias(c)
            for c, source in FULL_COLUMNS.items()
        ]
    )


def export_rows(creators: DataFrame, export_type: str, exported_at_ms: int) -> DataFrame:
    """Exportable rows in file order, projected for the ``quick`` or ``full`` list."""
    rows = exportable(creators)
    if export_type == "quick":
        return quick_rows(rows.orderBy("import_id", "row_index"))
    if export_type == "full":
        return full_rows(rows.orderBy("import_id", "row_index"), exported_at_ms)
    raise ValueError(f"unknown export type: {export_type}")


def export_name(export_type: str, import_id: str, exported_at_ms: int) -> str:
    return f"export-{export_type}-{import_id}-{exported_at_ms}.csv"


def write_export(
    creators: DataFrame, import_id: str, export_type: str, folder: str, exported_at_ms: int,
    single_file: bool = False,
) -> DataFrame:
    """Write the CSV of one import and return its export_history row.

    Many part files by default; the row count comes from the write itself. ``single_file`` makes
    one file of them, see ``join_parts``; no task sorts or writes more than its range of rows.
    """
    rows = export_rows(
        creators.where(F.col("import_id") == import_id), export_type, exported_at_ms
    )
    seen = Observation("export")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    name = export_name(export_type, import_id, exported_at_ms)
    if single_file:
        parts = f"{folder}/_parts-{name}"
        rows.write.mode("overwrite").options(**CSV_OPTIONS | {"header": False}).csv(parts)
        join_parts(rows.sparkSession, parts, f"{folder}/{name}", ",".join(rows.columns) + "\n")
    else:
        rows.write.options(**CSV_OPTIONS).csv(f"{folder}/{name}")
    return export_record(
        creators.sparkSession, import_id, export_type, name, seen.get["rows"], exported_at_ms
    )


def join_parts(spark: SparkSession, parts: str, target: str, header: str) -> None:
    """Replace ``target`` by one file: ``header``, then the part files of a folder in their order.

    A file system that can concatenate takes over the blocks of the parts and moves no data. On a
    shared disk each part is put at its place by a task; one that runs again writes the same bytes.
    Other file systems hold no file that several tasks can write: ValueError, the parts stay.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(conf)
    found = [
        (f.getPath(), f.getLen())
        for f in files.listStatus(jvm.org.apache.hadoop.fs.Path(parts))
        if f.getPath().getName().startswith("part-") and f.getLen()
    ]
    found.sort(key=lambda part: int(part[0].getName().split("-")[1]))
    local = files.getUri().getScheme() == "file"
    if not local and not files.hasPathCapability(path, "fs.capability.paths.concat"):
        raise ValueError(f"no file can be joined from {parts} in {files.getUri()}")
    drop_folder(spark, target)
    if local:
        places, at = [(None, 0)], len(header.encode())
        for part, size in found:
            places.append((part.toUri().getPath(), at))
            at += size
        _place(spark, places, path.toUri().getPath(), header)
    else:
        out = files.create(path, True)
        out.write(bytearray(header.encode()))
        out.close()
        if found:
            sources = spark.sparkContext._gateway.new_array(
                jvm.org.apache.hadoop.fs.Path, len(found)
            )
            for k, (part, _) in enumerate(found):
                sources[k] = part
            files.concat(path, sources)
    drop_folder(spark, parts)


def _place(
    spark: SparkSession, places: list[tuple[str | None, int]], target: str, header: str
) -> None:
    """Write every (part, offset) into ``target``; the header has no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = os.open(target, os.O_CREAT | os.O_WRONLY, 0o644)
        with os.fdopen(out, "wb", buffering=0) as whole:
            for batch in batches:
                for row in batch.to_pylist():
                    whole.seek(row["at"])
                    if row["part"] is None:
                        whole.write(header.encode())
                        continue
                    with open(row["part"], "rb") as part:
                        while block := part.read(COPY_BYTES):
                            whole.write(block)
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    rows = spark.createDataFrame(places, "part string, at long")  # a row for each part file
    rows.repartition(len(places), "at").mapInArrow(run, "n long").write.format("noop").mode(
        "overwrite"
    ).save()


def export_record(
    spark: SparkSession, import_id: str | None, export_type: str, file_name: str,
    row_count: int, created_at_ms: int, filter_snapshot: Column | None = None,
) -> DataFrame:
    """One export_history row to append."""
    row = spark.range(1).select(
        F.sha2(F.lit(file_name), 256).alias("id"),
        F.lit(import_id).alias("import_id"),
        F.lit(export_type).alias("export_type"),
        (F.lit(None) if filter_snapshot is None else F.to_json(filter_snapshot))
        .alias("filter_snapshot"),
        F.lit(file_name).alias("file_name"),
        F.lit(row_count).alias("row_count"),
        F.timestamp_millis(F.lit(created_at_ms)).alias("created_at"),
    )
    return conform(row, EXPORT_HISTORY)
