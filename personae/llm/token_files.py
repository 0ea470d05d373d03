"""Token ids as ORC files: written in id order, read back stripe by stripe.

Documents are range-partitioned by id; each task encodes its range in order and writes one
file. ORC stores the ids of a stripe in its integer run-length encoding, keeps row indexes with
minima and maxima for every ``ROWS_PER_INDEX`` rows, and a Bloom filter on ``doc_id`` beside
them, so that a lookup by id skips files, stripes and row groups from metadata, while a full
read splits files at stripes. Every row also stores ``offset``, the ids before it in its file:
with the totals of the files (one row each) any document's place in the whole stream follows
without another pass or sort.

The library `tokenizers` encodes the white-space chunks that a task meets; its file of the
given kind makes no token across white space, so whole texts follow by concatenation.

Defined cases: null and empty texts hold the end id alone. A null doc_id sorts first; rows
with one doc_id, and repeated rows, are ordered by a hash of their text. An empty table makes
files without rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from personae.llm.batches import text_steps
from personae.llm.chunks import MEMORY, Splitter, TokenStream
from personae.operators.scale import scratch_dir

END = 1
ROWS_PER_INDEX = 1_000
STRIPE_BYTES = 16 << 20
SCHEMA = "doc_id bigint, offset bigint, n_tokens int, ids array<int>"


@cache
def stream(path: str, memory: int = MEMORY, end: int | None = None) -> TokenStream:
    """One encoder for each Python worker, tokenizer file and end id."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()

    def encode(chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in tool.encode_batch_fast(chunks, add_special_tokens=False)]

    return TokenStream(Splitter.from_file(path), encode, memory, end)


def write(
    docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text",
    end: int | None = END, files: int | None = None,
) -> None:
    """Encode every text, append ``end``, write ORC files in ascending id order."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("_tie"),
    )
    placed = rows.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def run(batches):
        offset = 0
        for batch in batches:
            for i, j, texts in text_steps(batch.column(1)):
                ids, counts = stream(tokenizer, end=end).flat(texts)
                before = offset + np.cumsum(counts) - counts
                offset += int(counts.sum())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[i:j], "offset": before,
                    "n_tokens": counts.astype(np.int32),
                    "ids": pa.ListArray.from_arrays(
                        np.concatenate(([0], np.cumsum(counts))).astype(np.int32),
                        ids.view(np.int32),
                    ),
                })

    (
        placed.select("doc_id", "text").mapInArrow(run, SCHEMA)
        .write.mode("overwrite")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("orc.stripe.size", STRIPE_BYTES).option("orc.compress", "ZSTD")
        .orc(out)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with the name of each one's file."""
    return spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_name"))


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents; stripes that cannot hold them are not read."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(ids))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): ids in all earlier files. One row for each file."""
    # files are numbered by partition, and partitions are ranges of ids
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    totals = (
        read(spark, path).select("file", (F.col("offset") + F.col("n_tokens")).alias("end"))
        .groupBy("file").agg(F.max("end").alias("ids"))
    )
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Place, length and checksum of every document, from the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat = ids.flatten().to_numpy().astype("<u4")
            ends = np.cumsum(batch.column(2).to_numpy())
            crc = [zlib.crc32(part.tobytes()) for part in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "offset": batch.column(1),
                "n_tokens": batch.column(2).cast(pa.int64()), "ids_crc32": crc,
                "file": batch.column(4),
            })

    rows = read(spark, path).mapInArrow(
        run, "doc_id long, offset long, n_tokens long, ids_crc32 long, file string"
    )
    return rows.join(F.broadcast(starts(spark, path)), "file").select(  # a row for each file
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to a new folder in the cluster's shared scratch space and read back."""
    spark = docs.sparkSession
    out = f"{scratch_dir(spark)}/personae/token-files-{uuid.uuid4().hex}"
    write(docs, tokenizer, out, **options)
    return digests(spark, out)
