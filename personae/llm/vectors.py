"""Vectors in shards, and a query set run against every shard.

Valid rows are packed, where they are scanned, into shards of at most ``SHARD`` rows: ids and
components as two byte arrays. The rows that are queries make a chunk for each shard. Every
chunk meets every shard once; a shard travels once, the much smaller chunks are copied to the
shards, and a task streams over the chunks of one shard after another, with the shard's index
built once. Results are the best ``k`` of each query and shard, merged by query.

A row is known by its shard and place, so repeated ids and repeated rows are rows of their own;
only the query's own row is no candidate. Vectors meet vectors of their own dimension only.
Rows without id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personae.operators.scale import materialize

SHARD = 16_384
_PACKED = "shard long, dim int, rows int, ids binary, data binary"
_MOVED = f"{_PACKED}, chunk long, place binary"

# builds a shard's index from ids and matrix; the result maps query vectors, and their own
# row in this shard (-1: not here), to arrays (query number, id, score) of the best rows
Search = Callable[[np.ndarray, np.ndarray], Callable]


def finite(vec: str) -> Column:
    """The vector has components, and all of them are finite numbers."""
    big = F.lit(float("inf"))
    return F.coalesce(
        (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)),
        F.lit(False),
    )


def pack(df: DataFrame, id_col: str, vec_col: str, shard: int = SHARD) -> DataFrame:
    """Stored table of shards, from the valid rows of ``df``."""
    rows = df.where(finite(vec_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")
    ).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            parts = waiting.pop(dim)
            ids = np.concatenate([p[0] for p in parts])
            data = np.concatenate([p[1] for p in parts])
            number += 1
            return pa.RecordBatch.from_pydict({
                "shard": [number], "dim": pa.array([dim], pa.int32()),
                "rows": pa.array([len(ids)], pa.int32()),
                "ids": [ids.tobytes()], "data": [data.tobytes()],
            })

        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                part = batch.slice(at, shard)
                ids, vecs = part.column(0).to_numpy(), part.column(1)
                sizes = np.diff(vecs.offsets.to_numpy())
                flat, first = vecs.flatten().to_numpy(), np.cumsum(sizes) - sizes
                for dim in np.unique(sizes):
                    own = np.flatnonzero(sizes == dim)
                    data = flat[first[own][:, None] + np.arange(dim)]
                    held = waiting.setdefault(int(dim), [])
                    if held and sum(len(i) for i, _ in held) + len(own) > shard:
                        yield flush(int(dim))
                        held = waiting.setdefault(int(dim), [])
                    held.append((ids[own], data))
        for dim in list(waiting):
            yield flush(dim)

    return materialize(rows.mapInArrow(run, _PACKED), "vector-shards")


def _matrix(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
    data = np.frombuffer(batch.column("data")[i].as_py(), np.float64)
    return ids, data.reshape(len(ids), -1)


def _chunks(shards: DataFrame, divisor: int) -> DataFrame:
    """The queries of each shard, with their places in it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, data = _matrix(batch, i)
                place = np.flatnonzero(ids % divisor == 0)
                if len(place):
                    yield pa.RecordBatch.from_pydict({
                        "chunk": batch.column("shard")[i : i + 1],
                        "dim": batch.column("dim")[i : i + 1],
                        "rows": pa.array([len(place)], pa.int32()),
                        "ids": [ids[place].tobytes()], "data": [data[place].tobytes()],
                        "place": [place.astype(np.int64).tobytes()],
                    })

    return shards.mapInArrow(
        run, "chunk long, dim int, rows int, ids binary, data binary, place binary"
    )


def search(
    shards: DataFrame, divisor: int, k: int, index: Search, score_type: str
) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` rows of each query.

    Queries are the rows whose id ``divisor`` divides. ``index`` builds the search of a shard.
    """
    chunks = _chunks(shards, divisor)
    pairs = chunks.join(shards.select("shard", "dim"), "dim")  # blocks, on one dimension
    none = F.lit(None)
    moved = shards.select(
        "shard", "dim", "rows", "ids", "data",
        F.lit(-1).cast("long").alias("chunk"), none.cast("binary").alias("place"),
    ).unionByName(pairs.select("shard", "dim", "rows", "ids", "data", "chunk", "place"))
    parts = max(1, shards.count())
    placed = moved.repartition(parts, "shard").sortWithinPartitions("shard", "chunk")

    def run(batches):
        current, find = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, chunk = batch.column("shard")[i].as_py(), batch.column("chunk")[i].as_py()
                ids, data = _matrix(batch, i)
                if chunk < 0:
                    current, find = shard, index(ids, data)
                    continue
                place = np.frombuffer(batch.column("place")[i].as_py(), np.int64)
                own = place if chunk == current else np.full(len(place), -1)
                q, vec_id, score = find(data, own)
                if len(q):
                    yield pa.RecordBatch.from_pydict({
                        "chunk": np.full(len(q), chunk), "place": place[q],
                        "query_id": ids[q], "vec_id": vec_id, "score": score,
                    })

    found = placed.mapInArrow(
        run, f"chunk long, place long, query_id long, vec_id long, score {score_type}"
    )
    best = Window.partitionBy("chunk", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
