"""Best-fit packing with several permitted sequence lengths.

Documents are cut into pieces of at most the longest permitted length (no token is dropped)
and the pieces are dealt at random to groups of about ``GROUP`` pieces. Each group is packed
on its own, longest piece first:

* best fit: a piece goes into the open bin that it leaves with the least room;
* if it fits nowhere, a bin of the least-cost size is opened: for each permitted length the
  pieces still to come are poured into the room left (a fill from the histogram of remaining
  lengths), and the size with the least cost per token held wins. The cost of a bin is its
  length plus ``OVERHEAD``, so all lengths are weighed against each other jointly;
* at the end every bin is downsized to the shortest permitted length that holds its contents.

The waste that grouping adds is at most a few unfilled bins per group, independent of the size
of the input. Nothing is gathered in one place; a group holds two integers for each piece.

Defined cases: null, empty and blank texts have no tokens and one piece of length 0, in a bin
of the shortest length. Null and repeated ids are kept; a row is a document. An empty table
packs to none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.llm.batches import map_rows, text_steps
from personae.llm.chunks import MEMORY
from personae.llm.token_files import stream

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
GROUP = 5_000


class Packer:
    """Best fit over one group of pieces, whose lengths must not increase."""

    def __init__(self, lengths: Sequence[int], histogram: np.ndarray, overhead: int = OVERHEAD):
        self.sizes = sorted(lengths)
        self.overhead = overhead
        self.left = histogram.copy()  # pieces still to come, by length
        self.room: list[tuple[int, int]] = []  # (room left, bin), ascending
        self.bins: list[list[int]] = []  # [capacity, tokens held]
        self._plan: dict[int, int] = {}

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in the bin) of the next piece."""
        self.left[length] -= 1
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            _, k = self.room.pop(at)
        else:
            k = len(self.bins)
            self.bins.append([self._cheapest(length), 0])
        capacity, used = self.bins[k]
        self.bins[k][1] = used + length
        if capacity > used + length or not length:
            insort(self.room, (capacity - used - length, k))
        return k, used

    def _cheapest(self, length: int) -> int:
        """Size with the least cost per token; decided anew after every 64 openings."""
        if len(self.bins) % 64 == 0:
            self._plan.clear()
        if length not in self._plan:
            fit = [s for s in self.sizes if s >= length]
            cost = [(s + self.overhead) / max(1, length + self._fill(s - length)) for s in fit]
            self._plan[length] = fit[int(np.argmin(cost))]
        return self._plan[length]

    def _fill(self, room: int) -> int:
        """Tokens that the longest fitting pieces to come would put into ``room``."""
        held = 0
        taken: dict[int, int] = {}
        while room > 0:
            there = np.flatnonzero(self.left[1 : room + 1] > 0)[::-1] + 1
            there = next((int(x) for x in there if self.left[x] > taken.get(int(x), 0)), 0)
            if not there:
                break
            taken[there] = taken.get(there, 0) + 1
            held += there
            room -= there
        return held

    def downsized(self) -> list[int]:
        """Shortest permitted length that holds the contents of each bin."""
        return [self.sizes[bisect_left(self.sizes, used)] for _, used in self.bins]


def pieces(df: DataFrame, length_col: str, longest: int) -> DataFrame:
    """One row for each piece: ``piece`` number, ``start`` in the document, ``length``."""
    n = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    last = F.greatest(F.floor((n - 1) / longest), F.lit(0)).cast("long")
    rows = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * longest
    return rows.withColumn("start", start).withColumn(
        "length", F.least(n - start, F.lit(longest)).cast("int")
    )


def pack(
    df: DataFrame, length_col: str = "n_tokens", keep: Sequence[str] = ("doc_id",),
    lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, group: int = GROUP,
) -> DataFrame:
    """``keep`` columns of each piece with its place.

    ``df`` should be stored: it is counted once to choose the number of groups. Columns:
    piece, start, length, bin_id ("group-number"), bin_size, bin_offset.
    """
    if min(lengths) < 1:
        raise ValueError("permitted lengths must be positive")
    longest = max(lengths)
    cut = pieces(df.select(*keep, length_col), length_col, longest).select(
        *keep, "piece", "start", "length"
    )
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn(
        "_group", F.pmod(F.xxhash64(*keep, "piece", F.monotonically_increasing_id()), groups)
    )
    # several groups may share a partition: the sort keeps each together, longest first
    placed = dealt.repartition(groups, "_group").sortWithinPartitions(
        "_group", F.desc("length"), *keep, "piece"
    )
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = (
        f"{kept}, piece long, start long, length int, bin_id string, bin_size int, bin_offset int"
    )
    names = [*keep, "piece", "start", "length"]

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            number = batch.column(len(names)).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if waiting and number[i] != current:
                    yield from _packed(waiting, names, current, lengths, overhead)
                    waiting = []
                current = number[i]
                waiting.append(batch.slice(i, j - i))
        if waiting:
            yield from _packed(waiting, names, current, lengths, overhead)

    return placed.mapInArrow(run, schema)


def _packed(parts, names, number, lengths, overhead):
    sizes = np.concatenate([p.column(len(names) - 1).to_numpy() for p in parts])
    packer = Packer(lengths, np.bincount(sizes, minlength=max(lengths) + 1), overhead)
    places = [packer.place(int(n)) for n in sizes]
    final, at = packer.downsized(), 0
    for part in parts:
        own = places[at : at + part.num_rows]
        at += part.num_rows
        yield pa.RecordBatch.from_pydict(
            {n: part.column(k) for k, n in enumerate(names)} | {
                "bin_id": [f"{number}-{k}" for k, _ in own],
                "bin_size": pa.array([final[k] for k, _ in own], pa.int32()),
                "bin_offset": pa.array([o for _, o in own], pa.int32()),
            }
        )


def token_counts(
    df: DataFrame, tokenizer: str, text_col: str = "text",
    keep: Sequence[str | Column] = ("doc_id",), memory: int = MEMORY,
) -> DataFrame:
    """``keep`` columns of each row with ``n_tokens`` of its whole text.

    ``memory``: chunks that a worker remembers.
    """
    kept = df.select(*keep, F.col(text_col).alias("_text"))
    names = kept.columns[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])

    def run(batch):
        for i, j, texts in text_steps(batch.column(len(names))):
            yield {n: batch.column(k)[i:j] for k, n in enumerate(names)} | {
                "n_tokens": stream(tokenizer, memory).counts(texts)
            }

    return map_rows(kept, run, f"{schema}n_tokens long")
