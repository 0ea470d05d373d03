"""Exact top-k by integer inner product, block at a time.

A vector is a document whose terms are the components that are not zero, weighted with
floor(scale * x). A shard's documents are put into id order and cut into range blocks; a block
has a forward index (its weights, row by row) and for each term the largest and the smallest
weight. For each query the blocks are ordered by the sum of term maxima, max(q t) over the
block's weights t, which bounds every score in it. Blocks are scored through their forward
indexes in that order until the bound falls below the k-th score found; equal bounds are still
scored, as ties go to the smaller id.

Defined cases: see ``vectors`` for nulls, repeated rows and dimensions. Scores are exact
integers; beyond 2^63 they are held at the ends of a long. A query with fewer than k
candidates returns them all, one with none returns no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from personae.llm import vectors

BLOCK = 128
_EXACT = 2.0**53


class Blocks:
    """Range blocks of one shard."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, block: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.weights = ids[order], weights[order]
        self.row = np.empty(len(order), np.int64)  # place in the shard -> place in id order
        self.row[order] = np.arange(len(order))
        self.start = np.arange(0, len(ids), block)
        self.size = block
        self.top = np.maximum.reduceat(self.weights, self.start, axis=0)
        self.low = np.minimum.reduceat(self.weights, self.start, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(q, 0) @ self.top.T + np.minimum(q, 0) @ self.low.T


def _weights(data: np.ndarray, scale: int) -> np.ndarray:
    """Integers in float64 where products stay exact, Python integers where they may not."""
    w = np.floor(scale * data)
    largest = np.abs(w).max(initial=0.0)
    if largest * largest * max(1, w.shape[1]) < _EXACT:
        return w
    whole = np.frompyfunc(int, 1, 1)(w)
    return whole.reshape(w.shape)


def _long(score: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in score], np.int64)
    return score.astype(np.int64)


def index(k: int, scale: int, block: int):
    """Builder of a shard's search, for ``vectors.search``."""

    def build(ids: np.ndarray, data: np.ndarray):
        shard = Blocks(ids, _weights(data, scale), block)

        def find(queries: np.ndarray, own: np.ndarray):
            w = _weights(queries, scale)
            blocks = shard
            if w.dtype != blocks.weights.dtype or w.dtype != object and (
                np.abs(w).max(initial=0) * np.abs(blocks.weights).max(initial=0) * w.shape[1]
                >= _EXACT
            ):
                # one side needs whole numbers: both get them
                whole = np.frompyfunc(int, 1, 1)
                w = whole(w).reshape(w.shape)
                blocks = Blocks(ids, whole(_weights(data, scale)).reshape(data.shape), block)
            own_row = np.where(own >= 0, blocks.row[np.maximum(own, 0)], -1)
            return _best(blocks, w, own_row, k)

        return find

    return build


def _best(blocks: Blocks, w: np.ndarray, own: np.ndarray, k: int):
    bounds = blocks.bounds(w)
    if bounds.dtype == object:
        order = np.array([sorted(range(len(b)), key=lambda j, b=b: -b[j]) for b in bounds])
    else:
        order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[tuple[np.ndarray, np.ndarray]] = [
        (np.zeros(0, w.dtype), np.zeros(0, np.int64)) for _ in w
    ]
    alive = np.arange(len(w))
    for step in range(order.shape[1]):
        block = order[alive, step]
        go = np.array([
            len(best[q][0]) < k or bounds[q, b] >= best[q][0][-1]
            for q, b in zip(alive, block, strict=True)
        ], bool)
        alive, block = alive[go], block[go]
        if not len(alive):
            break
        for b in np.unique(block):
            queries = alive[block == b]
            first = int(blocks.start[b])
            last = min(first + blocks.size, len(blocks.ids))
            scores = w[queries] @ blocks.weights[first:last].T
            for q, row in zip(queries, scores, strict=True):
                held = best[q]
                good = np.ones(len(row), bool) if len(held[0]) < k else row >= held[0][-1]
                if first <= own[q] < last:
                    good[own[q] - first] = False
                good = np.flatnonzero(good)
                if len(good):
                    s = np.concatenate((held[0], row[good]))
                    v = np.concatenate((held[1], blocks.ids[first + good]))
                    first_k = np.lexsort((v, -s))[:k]
                    best[q] = s[first_k], v[first_k]
    q = np.repeat(np.arange(len(w)), [len(s) for s, _ in best])
    if not len(q):
        return q, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return q, np.concatenate([v for _, v in best]), _long(np.concatenate([s for s, _ in best]))


def top_k(
    df: DataFrame, k: int = 20, divisor: int = 20, scale: int = 64, block: int = BLOCK,
    id_col: str = "vec_id", vec_col: str = "embedding", shard: int = vectors.SHARD,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id ``divisor`` divides."""
    shards = vectors.pack(df, id_col, vec_col, shard)
    return vectors.search(shards, divisor, k, index(k, scale, block), "long")
