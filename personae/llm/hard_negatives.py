"""Hard-negative mining by an exact matrix product in a residue number system.

Components become w = floor(scale * x). A matrix of them is kept as one matrix of centred
remainders for each of several primes below 1024. Two such matrices are multiplied in float32,
``INNER`` components at a time: 64 products of remainders of at most 510 stay below 2^24, so
that every partial sum is a whole number that float32 holds. The remainders of a score are joined
by Chinese remaindering (mixed radix with signed digits). The primes are as many as the largest
norm asks for: by Cauchy and Schwarz no score leaves the signed range of their product.

Rows are dealt evenly to groups, one task each, and packed into blocks. The anchors of each block
(rows whose id ``divisor`` divides) travel to every group, a group's own blocks travel once. A
first pass finds each anchor's positives, its best rows of the same label; a second one the best
rows of other labels within the window of scores that each positive sets,

    low * positive <= 100 * negative <= high * positive.

Tasks send the best few of each anchor and group; Spark merges them. A label, an id or a vector
may belong to any share of the rows, as no step groups by them.

Defined cases: rows without id, label or vector, or with a component that is null or not finite,
take no part; nor do empty vectors. Rows meet rows of their own dimension. A row is known by its
block and place: repeated ids and repeated rows are rows of their own, equal scores go to the
smaller id. An anchor without positives, or a positive without rows in its window, gives no row.
Scaled components are held within +-sqrt(10^38 / dimension), scores within a long. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from personae.llm.vectors import finite
from personae.operators.scale import materialize

LARGEST = 1021
INNER = 64
# components that a group holds, rows of a block, anchors multiplied at once
GROUP = 1 << 22
BLOCK = 8_192
STEP = 64
_BLOCKS = "grp int, block long, dim int, ids binary, labels binary, data binary"
_LOWEST = -(1 << 62)


def primes(bound: int) -> list[int]:
    """Primes from ``LARGEST`` down whose product exceeds 2 * ``bound``."""
    found: list[int] = []
    for p in range(LARGEST, 2, -2):
        if math.prod(found) > 2 * bound:
            break
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
    return found


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """A remainder of x modulo p, about between -p/2 and p/2; exact in x's own float type."""
    return x - p * np.rint(x / x.dtype.type(p))


def residues(w: np.ndarray, moduli: list[int]) -> np.ndarray:
    """int16 matrices, one for each modulus, of whole numbers held in float64."""
    return np.stack([_centred(np.fmod(w, p), p).astype(np.int16) for p in moduli])


def product(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact scores of all rows of ``a`` with all of ``b``: int64, or Python integers."""
    parts = []
    for x, y, p in zip(a, b, moduli, strict=True):
        total = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, x.shape[1], INNER):
            here = slice(at, at + INNER)
            part = x[:, here].astype(np.float32) @ y[:, here].astype(np.float32).T
            total = _centred(total + _centred(part, p), p)
        parts.append(total)
    return _joined(parts, moduli)


def _joined(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The whole numbers of smallest size with these remainders."""
    if math.prod(moduli) < 1 << 53:
        value, radix = parts[0].astype(np.float64), 1
        value = _centred(value, moduli[0])
        for part, p, before in zip(parts[1:], moduli[1:], moduli, strict=False):
            radix *= before
            digit = _centred(part - value, p) * pow(radix, -1, p)
            value = value + _centred(digit, p) * radix
        return value.astype(np.int64)
    value, radix = np.zeros(parts[0].shape, object), 1
    for part, p in zip(parts, moduli, strict=True):
        whole = part.astype(np.int64).astype(object)
        digit = (whole - value) * pow(radix, -1, p) % p
        value = value + np.where(digit > p // 2, digit - p, digit) * radix
        radix *= p
    return value


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest allowed scores of each row, earlier columns first."""
    if score.dtype == object:
        found = [
            (i, j) for i in range(len(score))
            for j in sorted(np.flatnonzero(allowed[i]), key=lambda j, i=i: (-score[i, j], j))[:k]
        ]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)
    held = np.where(allowed, score, _LOWEST)
    if held.shape[1] > k:
        least = np.partition(held, -k, axis=1)[:, -k]
        allowed = allowed & (held >= least[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((col, -held[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    limit = math.sqrt(1e38 / max(1, x.shape[1])) * (1 - 1e-9)
    return np.clip(np.floor(scale * x), -limit, limit).astype(np.float64)


def _packed(rows: DataFrame, moduli: list[int], scale: float, groups: int) -> DataFrame:
    """Stored blocks of rows (id, label, v), dealt evenly to ``groups``, in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
        number = 0

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, labels, data = (np.concatenate(c) for c in zip(*waiting.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")
            number += 1
            return pa.RecordBatch.from_pydict({
                "grp": pa.array([group], pa.int32()), "block": [group << 32 | number],
                "dim": pa.array([dim], pa.int32()), "ids": [ids[order].tobytes()],
                "labels": [labels[order].tobytes()],
                "data": [residues(_scaled(data[order], scale), moduli).tobytes()],
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)[0].as_py()
            ids, labels = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            vecs = batch.column(3)
            sizes = np.diff(vecs.offsets.to_numpy())
            flat, first = vecs.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for dim in map(int, np.unique(sizes)):
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), BLOCK):
                    some = own[at : at + BLOCK]
                    held = waiting.setdefault(dim, [])
                    if sum(len(i) for i, _, _ in held) + len(some) > BLOCK:
                        yield flush(dim)
                        held = waiting.setdefault(dim, [])
                    held.append((
                        ids[some], labels[some], flat[first[some][:, None] + np.arange(dim)]
                    ))
        for dim in list(waiting):
            yield flush(dim)

    dealt = rows.withColumn(
        "grp", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")
    ).select("grp", "id", "label", "v")
    placed = dealt.repartitionById(groups, F.col("grp"))
    return materialize(placed.mapInArrow(run, _BLOCKS), "residue-blocks")


class _Block:
    """Rows of one block: ids, labels, and remainders by modulus."""

    def __init__(self, batch: pa.RecordBatch, i: int, moduli: list[int]):
        get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
        self.key = batch.column("block")[i].as_py()
        self.dim = batch.column("dim")[i].as_py()
        self.ids, self.labels = get("ids", np.int64), get("labels", np.int64)
        self.data = get("data", np.int16).reshape(len(moduli), len(self.ids), self.dim)


def _anchors(blocks: DataFrame, divisor: int, moduli: list[int]) -> DataFrame:
    """The anchors of each block, with their places in it."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, moduli)
                place = np.flatnonzero(block.ids % divisor == 0)
                if len(place):
                    yield pa.RecordBatch.from_pydict({
                        "block": [block.key], "dim": pa.array([block.dim], pa.int32()),
                        "ids": [block.ids[place].tobytes()],
                        "labels": [block.labels[place].tobytes()],
                        "data": [block.data[:, place].tobytes()],
                        "place": [place.astype(np.int64).tobytes()],
                    })

    schema = "block long, dim int, ids binary, labels binary, data binary, place binary"
    return blocks.mapInArrow(run, schema)


def _meet(
    blocks: DataFrame, anchors: DataFrame, groups: int, moduli: list[int], find, schema: str
) -> DataFrame:
    """Rows that ``find(anchors, places, blocks of one group, positives)`` yields as columns.

    Every row of ``anchors`` meets every group once.
    """
    copied = anchors.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    moved = blocks.withColumn("anchor", F.lit(False)).unionByName(
        copied.withColumn("anchor", F.lit(True)), allowMissingColumns=True
    )
    placed = moved.repartitionById(groups, F.col("grp")).sortWithinPartitions("anchor", "block")
    names = [part.split()[0] for part in schema.split(", ")]
    known = "positives" in anchors.columns

    def run(batches):
        held: list[_Block] = []
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, moduli)
                if not batch.column("anchor")[i].as_py():
                    held.append(block)
                    continue
                place = np.frombuffer(batch.column("place")[i].as_py(), np.int64)
                more = batch.column("positives")[i].as_py() if known else None
                for columns in find(block, place, held, more):
                    yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})

    return placed.mapInArrow(run, schema)


def _numbers(values: np.ndarray) -> pa.Array:
    """Scores as longs, or as decimals where they are Python integers."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _merged(row, score, ids, k: int) -> np.ndarray:
    """Which entries are among the ``k`` best of their row: larger scores, then smaller ids."""
    if score.dtype == object:
        order = np.array(
            sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), np.int64
        )
    else:
        order = np.lexsort((ids, -score, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[place < k]


def mine(
    df: DataFrame, divisor: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
    high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding",
    label_col: str = "label", group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    rows = df.where(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(vec_col)
    ).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"),
    )
    # floor moves a component by less than 1
    norm = F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1)
    )
    count, largest, dim = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    bound = min(10**38, int(largest * (1 + 1e-9)) if largest and math.isfinite(largest) else 10**38)
    moduli = primes(bound)
    score_type = "long" if math.prod(moduli) < 1 << 53 else "decimal(38,0)"
    # as many groups as tasks that can run, more where a group would hold too much
    cores = spark.sparkContext.defaultParallelism
    groups = max(1, min(2 * cores, count // 1024), -(-count * (dim or 1) // group))
    blocks = _packed(rows, moduli, scale, groups)
    anchors = _anchors(blocks, divisor, moduli)

    def same_label(block, place, held, _):
        for at in range(0, len(place), STEP):
            some = slice(at, at + STEP)
            labels, own = block.labels[some], place[some]
            found = []
            for other in held:
                if other.dim != block.dim:
                    continue
                score = product(block.data[:, some], other.data, moduli)
                allowed = labels[:, None] == other.labels
                if other.key == block.key:
                    allowed[np.arange(len(own)), own] = False
                row, col = best(score, allowed, positives)
                found.append((row, score[row, col], other.ids[col]))
            if found:
                row, score, ids = (np.concatenate(c) for c in zip(*found, strict=True))
                kept = _merged(row, score, ids, positives)
                yield {
                    "block": np.full(len(kept), block.key), "place": own[row[kept]],
                    "id": ids[kept], "score": _numbers(score[kept]),
                }

    near = _meet(
        blocks, anchors, groups, moduli, same_label,
        f"block long, place long, id long, score {score_type}",
    )
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    chosen = near.groupBy("block").agg(
        F.collect_list(F.struct("place", "nth", "id", "score")).alias("positives")
    )
    asking = materialize(anchors.join(chosen, "block"), "anchors-positives")

    def other_label(block, place, held, wanted):
        at = np.searchsorted(place, [w["place"] for w in wanted])
        nth = np.array([w["nth"] for w in wanted], np.int64)
        ids = np.array([w["id"] for w in wanted], np.int64)
        limit = np.array([int(w["score"]) for w in wanted], object)
        if score_type == "long":
            limit = limit.astype(np.int64)
        for first in range(0, len(place), STEP):
            some = slice(first, first + STEP)
            mine = np.flatnonzero((at >= first) & (at < first + STEP))
            row, bar = at[mine] - first, limit[mine][:, None]
            found = []
            for other in held:
                if other.dim != block.dim or not len(mine):
                    continue
                score = 100 * product(block.data[:, some], other.data, moduli)[row]
                allowed = (score >= low * bar) & (score <= high * bar)
                allowed &= block.labels[some][row][:, None] != other.labels
                q, col = best(score, allowed.astype(bool), negatives)
                found.append((q, score[q, col] // 100, other.ids[col]))
            if found:
                q, score, neg = (np.concatenate(c) for c in zip(*found, strict=True))
                kept = _merged(q, score, neg, negatives)
                own = mine[q[kept]]
                yield {
                    "block": np.full(len(kept), block.key), "place": place[at[own]],
                    "nth": nth[own].astype(np.int32), "anchor_id": block.ids[at[own]],
                    "positive_id": ids[own], "positive_score": _numbers(limit[own]),
                    "negative_id": neg[kept], "negative_score": _numbers(score[kept]),
                }

    hard = _meet(
        blocks, asking, groups, moduli, other_label,
        "block long, place long, nth int, anchor_id long, positive_id long, "
        f"positive_score {score_type}, negative_id long, negative_score {score_type}",
    )
    order = Window.partitionBy("block", "place", "nth").orderBy(
        F.desc("negative_score"), "negative_id"
    )
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    def held(name: str):
        ends = F.lit(-(2**63)).cast(score_type), F.lit(2**63 - 1).cast(score_type)
        return F.greatest(ends[0], F.least(ends[1], F.col(name))).cast("long").alias(name)

    return ranked.select(
        "anchor_id", "positive_id", "rank", "negative_id", held("positive_score"),
        held("negative_score"),
    )
