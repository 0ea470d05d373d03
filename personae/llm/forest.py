"""Approximate nearest neighbours by cosine: a hash-prefix forest.

Each tree gives a vector a hash string of ``BITS`` bits, the signs of as many random
projections, and is the sorted array of the strings of a shard's distinct vectors. A query
descends in every tree to the longest prefix that any string shares with its own, then all
trees ascend together, one bit at a time, until the rows below the shared prefixes number
``fraction`` of the shard (``least`` rows at the minimum) or the root is reached. The
candidates' cosines are computed in double precision; the best are computed once more with
correctly rounded sums, so that equal vectors get equal scores and ties go to the smaller id.

The trees are fixed random projections and need no fitting; every row is indexed. Vectors that
occur more than once are one entry with all their ids, so copies do not fill up the
candidates. Recall against brute force is measured by ``tests/llm`` and stated in the README.

Defined cases: zero vectors and those that ``vectors`` leaves out take no part; a query with
fewer than k candidates returns all. Scores of vectors whose squares leave the range of
doubles are computed after scaling by their largest component.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from personae.llm import vectors

BITS = 64
TREES = 64
FRACTION = 0.5
LEAST = 400


@cache
def _projections(dim: int, trees: int) -> np.ndarray:
    rng = np.random.default_rng(1_000_003 * dim + trees)
    return rng.standard_normal((dim, trees * BITS)).astype(np.float32)


def strings(unit: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings, one row for each tree, as integers with the first bit on top."""
    out = np.empty((trees, len(unit)), np.uint64)
    planes = _projections(unit.shape[1], trees)
    for at in range(0, len(unit), 2048):
        bits = unit[at : at + 2048].astype(np.float32) @ planes > 0
        packed = np.packbits(bits.reshape(-1, trees, BITS), axis=2)
        out[:, at : at + 2048] = packed.reshape(-1, trees * 8).view(">u8").T
    return out


def _unit(data: np.ndarray) -> np.ndarray:
    largest = np.abs(data).max(axis=1, keepdims=True)
    data = data / np.where(largest > 0, largest, 1)
    return data / np.maximum(np.sqrt((data * data).sum(axis=1, keepdims=True)), 1e-300)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine with correctly rounded sums."""
    if not (np.abs(a).max() < 1e150 and np.abs(b).max() < 1e150) or (
        np.abs(a).max() < 1e-150 or np.abs(b).max() < 1e-150
    ):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
    a, b = a.tolist(), b.tolist()
    dot = math.sumprod(a, b)
    return dot / math.sqrt(math.sumprod(a, a)) / math.sqrt(math.sumprod(b, b))


class Forest:
    """The trees of one shard."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, trees: int):
        self.all_ids, self.trees = ids, trees
        _, first, inverse = np.unique(
            np.ascontiguousarray(data).view(f"V{data.shape[1] * 8}").ravel(),
            return_index=True, return_inverse=True,
        )
        self.data, self.unit = data[first], _unit(data[first])
        by_entry = np.lexsort((ids, inverse.ravel()))
        self.rows = by_entry  # rows of an entry lie together, smallest id first
        self.starts = np.searchsorted(inverse.ravel()[by_entry], np.arange(len(first) + 1))
        hashed = strings(self.unit, trees)
        self.order = np.argsort(hashed, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(hashed, self.order, axis=1)

    def ranges(self, hashed: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in every tree (trees x queries) after the ascent."""
        queries = hashed.shape[1]
        low, high = np.zeros(hashed.shape, np.int64), np.zeros(hashed.shape, np.int64)
        depth = self._descend(hashed)
        open_ = np.ones(queries, bool)
        for level in range(int(depth.max(initial=0)), -1, -1):
            # a tree takes part once the ascent has come up to its own longest match
            act = np.flatnonzero(open_ & (depth.max(axis=0) >= level))
            if not len(act):
                continue
            below = np.uint64((1 << (BITS - level)) - 1)
            start = hashed[:, act] & ~below
            for t in range(self.trees):
                low[t, act] = np.searchsorted(self.sorted[t], start[t], "left")
                high[t, act] = np.searchsorted(self.sorted[t], start[t] | below, "right")
            total = (high[:, act] - low[:, act]).sum(axis=0)
            open_[act[total >= enough]] = False
            if not open_.any():
                break
        return low, high

    def _descend(self, hashed: np.ndarray) -> np.ndarray:
        """Bits of the longest prefix shared with any string, by tree and query."""
        out = np.zeros(hashed.shape, np.int64)
        size = self.sorted.shape[1]
        for t in range(self.trees):
            at = np.searchsorted(self.sorted[t], hashed[t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, size - 1)):
                differ = self.sorted[t][near] ^ hashed[t]
                out[t] = np.maximum(out[t], _leading_zeros(differ))
        return out


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    rest = x.copy()
    for bits in (32, 16, 8, 4, 2, 1):
        empty = rest >> np.uint64(64 - bits) == 0
        out[empty] += bits
        rest = np.where(empty, rest << np.uint64(bits), rest)
    return np.where(x == 0, 64, out)


def index(k: int, trees: int, fraction: float, least: int):
    """Builder of a shard's search, for ``vectors.search``."""

    def build(ids: np.ndarray, data: np.ndarray):
        forest = Forest(ids, data, trees)
        size = len(forest.data)
        # the trees' ranges overlap: so many rows with repetition reach so many distinct ones
        share = min(0.999, max(fraction, least / size))
        enough = int(-math.log(1 - share) * size) + 1

        def find(queries: np.ndarray, own: np.ndarray):
            unit = _unit(queries)
            low, high = forest.ranges(strings(unit, trees), enough)
            q_out, id_out, score_out = [], [], []
            marked = np.zeros(size, bool)
            for q in range(len(queries)):
                marked[:] = False
                for t in range(trees):
                    marked[forest.order[t, low[t, q] : high[t, q]]] = True
                there = np.flatnonzero(marked)
                near = forest.unit[there] @ unit[q]
                # k + 1 entries: the query's own row may be one of them
                if len(near) > k + 1:
                    limit = np.partition(near, -(k + 1))[-(k + 1)] - 1e-9
                    there = there[near >= limit]
                rows = []
                for entry in there:
                    score = cosine(forest.data[entry], queries[q])
                    a, b = forest.starts[entry], forest.starts[entry + 1]
                    rows += [
                        (-score, int(ids[r])) for r in forest.rows[a : min(b, a + k + 1)]
                        if r != own[q]
                    ]
                rows = sorted(rows)[:k]
                q_out += [q] * len(rows)
                id_out += [i for _, i in rows]
                score_out += [-s for s, _ in rows]
            return np.array(q_out, np.int64), np.array(id_out, np.int64), np.array(score_out)

        return find

    return build


def nearest(
    df: DataFrame, k: int = 5, divisor: int = 50, trees: int = TREES,
    fraction: float = FRACTION, least: int = LEAST,
    id_col: str = "vec_id", vec_col: str = "embedding", shard: int = vectors.SHARD,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id ``divisor`` divides."""
    some = df.where(F.exists(vec_col, lambda x: x != 0))
    shards = vectors.pack(some, id_col, vec_col, shard)
    return vectors.search(shards, divisor, k, index(k, trees, fraction, least), "double")
