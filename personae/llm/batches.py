"""Reading helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that one step of a numpy kernel works on, so that its temporary
# arrays stay at some tens of megabytes whatever the rows of a batch hold.
CHARS_PER_STEP = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def steps(texts: list[str | None], size: int = CHARS_PER_STEP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` characters together, one row at least."""
    yield from _ranges([len(t or "") for t in texts], size)


def text_steps(
    column: pa.Array, size: int = CHARS_PER_STEP
) -> Iterator[tuple[int, int, list[str | None]]]:
    """The same ranges of an Arrow column, with only their own texts as Python strings.

    What Arrow has freed goes back to the system, as a worker lives through many stages.
    """
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in _ranges(lengths, size):
        yield i, j, column[i:j].to_pylist()
    pa.default_memory_pool().release_unused()


def _ranges(lengths: list[int], size: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def judged(
    df: DataFrame, text_col: str, fn: Callable[[list[str | None]], dict[str, pa.Array]],
    schema: str, size: int = CHARS_PER_STEP,
) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``fn`` makes of its texts, about ``size`` characters at a time.

    Only the texts travel to Python, and only the new columns come back. Columns of ``df``
    with one of the new names are replaced.
    """
    names = [part.split()[0] for part in _fields(schema)]

    def run(texts: pa.Array) -> pa.Array:
        parts = [
            pa.StructArray.from_arrays([pa.array(columns[n]) for n in names], names)
            for columns in (fn(some) for _, _, some in text_steps(texts, size))
        ]
        return pa.concat_arrays(parts)

    # not deterministic as far as Spark may know: it must not be run once more in a filter
    udf = F.arrow_udf(run, f"struct<{schema}>").asNondeterministic()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*kept, udf(F.col(text_col)).alias("_judged")).select(
        *kept, *[F.col(f"_judged.{n}").alias(n) for n in names]
    )


def map_rows(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str
) -> DataFrame:
    """``mapInArrow`` of a function that yields columns by name for each batch."""
    names = [part.split()[0].strip("`") for part in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for columns in fn(batch):
                yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    parts, depth = [""], 0
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]
