"""N-gram Jaccard join: which texts share at least 80 % of their 5-word shingles.

A text is the set of hashes of its word 5-grams. Texts with one set are a class, and only
classes are compared. Two classes a, b link when 100 |a & b| >= 80 |a | b|, which is
180 |a & b| >= 80 (|a| + |b|).

Candidates come from count-vector R-trees. The hash range is cut into equal groups; a class is
the point of its shingle counts by group, with about ``PER_GROUP`` shingles per group. The
overlap of two classes is at most the sum of the coordinate minima of their points, and at most
that of a point and the upper corner of a box, so subtrees whose bound misses the needed overlap
are skipped. Pairs that survive at the leaves are verified on the sets themselves.

Which classes share a tree: with all shingles in one global order, linked classes of n shingles
have a common one among their first n - ceil(0.8 n) + 1. Frequent shingles come last in that
order, so these signatures are rare. The members of a signature's bucket go to the tree of the
bucket's smallest class, cut by size bands (powers of two; a class that may link upwards into
the next band is in both). This loses no link, and no tree grows with the corpus but by
near copies. A tree with more than ``BLOCK`` members is dealt out to blocks that each hold its
hub (smallest member) as well; afterwards only those not yet connected to the hub, by links
within their block, meet all other blocks. Inside a block a pair that is already connected is
not verified again, and sets travel only for one tree of each class and for trees whose
classes that has not connected. So groups of near copies cost time in proportion to their size, and no
pairs are ever listed: a tree returns, for each member that links join to a smaller one, the
smallest of those they join it to.

Defined cases: null, empty and blank texts have no shingles and link with nothing. Texts of
fewer than 5 words have one shingle. Rows with one doc_id and different texts are classes of
their own; null ids count as larger than all others. Class keys and shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from personae.llm.batches import map_rows, text_steps
from personae.llm.components import components
from personae.llm.words import shingle_set, word_hashes
from personae.operators.scale import materialize

WORDS = 5
PERCENT = 80
PER_GROUP = 2
BLOCK = 128
FANOUT = 8
# The most frequent shingles, so many at most, come last in the global order. They are
# counted where they occur so often in about LOCAL_ROWS shingles of one task. Any order
# gives the same result; this one keeps buckets small.
FREQUENT = 500_000
LOCAL_ROWS, LOCAL_LEAST = 1_000_000, 3
BROADCAST_IDS = 200_000


def _class(shingles: np.ndarray) -> int:
    key = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
    return int.from_bytes(key, "little", signed=True)


def _inspect(rows: DataFrame, names: list[str], fields: str, words: int) -> DataFrame:
    """One row for each document (kind 0) and for each locally frequent shingle (kind 1)."""
    empty = {n: None for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        types = None

        def frequent() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            key, n = key[n >= LOCAL_LEAST], n[n >= LOCAL_LEAST]
            nothing = {c: pa.nulls(len(key), types[c]) for c in empty}
            return pa.RecordBatch.from_pydict(nothing | {
                "kind": pa.array(np.ones(len(key)), pa.int32()),
                "cls": key.view(np.int64), "n": n,
            })

        for batch in batches:
            types = {c: batch.column(k).type for k, c in enumerate(names)}
            for i, j, texts in text_steps(batch.column(len(names))):
                sets = [shingle_set(word_hashes(t), words) for t in texts]
                keys = [_class(s) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(k)[i:j] for k, c in enumerate(names)} | {
                        "kind": pa.array(np.zeros(len(sets)), pa.int32()),
                        "cls": keys, "n": [len(s) for s in sets],
                    }
                )
                for key, s in zip(keys, sets, strict=True):
                    if key not in seen:
                        seen.add(key)
                        held.append(s)
                if sum(map(len, held)) > LOCAL_ROWS:
                    yield frequent()
                    held.clear()
                    seen.clear()
        if held:
            yield frequent()

    return rows.mapInArrow(run, f"{fields}, kind int, cls long, n long")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signatures(shingles: np.ndarray, often: np.ndarray, times: np.ndarray, percent: int):
    """First shingles of a set: rare ones by hash, then frequent ones by frequency."""
    rare = np.ones(len(shingles), bool)
    if len(often):
        at = np.searchsorted(often, shingles)
        at[at == len(often)] = 0
        rare = often[at] != shingles
    need = prefix_length(len(shingles), percent)
    first = shingles[rare]
    if len(first) < need:
        rest = shingles[~rare]
        first = np.concatenate((first, rest[np.lexsort((rest, times[at[~rare]]))]))
    return first[:need]


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts by hash group; the number of groups is a power of two."""
    bits = max(3, int(np.ceil(np.log2(max(1, len(shingles)) / PER_GROUP))))
    groups = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(groups, minlength=1 << bits)


def packed(point: np.ndarray) -> bytes:
    """A point in the narrowest integers that hold it, after a byte with their width."""
    width = 1 if point.max(initial=0) < 256 else 4
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _folded(points: list[np.ndarray]) -> np.ndarray:
    """Points brought to the coarsest grouping among them."""
    size = min(map(len, points))
    return np.array([p.reshape(size, -1).sum(axis=1, dtype=np.int32) for p in points])


class RTree:
    """Upper corners and smallest set sizes of boxes over points, ``FANOUT`` to a box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        side = max(1, int(np.ceil(np.sqrt(len(points) / FANOUT)))) * FANOUT
        slab = np.empty(len(points), np.int64)
        slab[np.argsort(points[:, 0], kind="stable")] = np.arange(len(points)) // side
        order = np.lexsort((points[:, 1], slab))  # sort-tile-recursive on two coordinates
        self.order = order
        self.levels = [(points[order], sizes[order])]
        while len(self.levels[-1][0]) > FANOUT:
            high, low = self.levels[-1]
            starts = np.arange(0, len(high), FANOUT)
            self.levels.append(
                (np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(low, starts))
            )

    def partners(self, q: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may link with a set of ``n`` shingles at ``q``, and their bounds."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            bound = np.minimum(high[nodes], q).sum(axis=1)
            good = (100 + percent) * bound >= percent * (low[nodes] + n)
            nodes, bound = nodes[good], bound[good]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes], bound


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _groups(batches, keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first ``keys`` columns, as lists of columns."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


_KEY = "center long, band int, i int, j int"


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("center", "band", "i", "j").sortWithinPartitions(
        "center", "band", "i", "j", "cls"
    )


def _merged(rows: list[tuple]) -> list[tuple]:
    """One row for each class; it asks if any of its rows does."""
    by: dict[int, tuple] = {}
    for row in rows:
        old = by.get(row[0])
        by[row[0]] = row if old is None else (*row[:1], row[1] or old[1], *row[2:])
    return list(by.values())


def _candidates(rows: list[tuple], percent: int) -> Iterator[tuple[int, int, int]]:
    """(bound, a, b): pairs of row numbers in one tree, of which at least one asks."""
    points = _folded([unpacked(r[3]) for r in rows])
    sizes = np.array([r[2] for r in rows])
    asks = np.array([r[1] for r in rows])
    tree = RTree(points, sizes)
    for a in np.flatnonzero(asks):
        there, bound = tree.partners(points[a], int(sizes[a]), percent)
        for b, most in zip(there.tolist(), bound.tolist(), strict=True):
            if b > a or b < a and not asks[b]:
                yield most, int(a), b


def _survivors(df: DataFrame, percent: int) -> DataFrame:
    """Rows (key, cls, asks, n, vec) whose class has a possible partner in its tree."""

    def run(batches):
        out: list[tuple] = []
        for key, rows in _groups(batches, 4):
            rows = _merged(rows)
            if len(rows) < 2:
                continue
            kept: set[int] = set()
            for _, a, b in _candidates(rows, percent):
                kept.update((a, b))
            out += [(*key, *rows[k][:2]) for k in sorted(kept)]
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows):
        names = ("center", "band", "i", "j", "cls", "asks")
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
        )

    return _grouped(df).mapInArrow(run, f"{_KEY}, cls long, asks boolean")


def _verified(df: DataFrame, percent: int) -> DataFrame:
    """(a, b): b is the least class of the tree that links join a to.

    From rows (key, cls, asks, n, vec, shingles).
    """

    def run(batches):
        for _, rows in _groups(batches, 4):
            rows = _merged(rows)
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            parent = list(range(len(rows)))

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            # rows are in the order of their classes, so the smaller number is the smaller class
            for _, a, b in sorted(_candidates(rows, percent), reverse=True):
                low, high = sorted((root(a), root(b)))
                if low != high and linked(sets[a], sets[b], percent):
                    parent[high] = low
            joined = [k for k in range(len(rows)) if root(k) != k]
            if joined:
                yield pa.RecordBatch.from_pydict(
                    {"a": [rows[k][0] for k in joined], "b": [rows[root(k)][0] for k in joined]}
                )

    return _grouped(df).mapInArrow(run, "a long, b long")


class _Search:
    """Stored intermediate tables of one join."""

    def __init__(self, texts: DataFrame, first: DataFrame, words: int, percent: int):
        self.texts, self.first, self.words, self.percent = texts, first, words, percent

    def signed(self, often: DataFrame) -> DataFrame:
        """cls, n, vec, sigs of each class, at least once."""
        got = often.toArrow()  # at most FREQUENT rows
        key = got["cls"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        shared = self.texts.sparkSession.sparkContext.broadcast(
            (key[order], got["n"].to_numpy()[order])
        )
        words, percent = self.words, self.percent

        def run(batches):
            key, times = shared.value
            seen: set[int] = set()
            for batch in batches:
                for _, _, texts in text_steps(batch.column("text")):
                    cls, n, vec, sigs = [], [], [], []
                    for text in texts:
                        s = shingle_set(word_hashes(text), words)
                        own = _class(s)
                        if not len(s) or own in seen:
                            continue
                        seen.add(own)
                        cls.append(own)
                        n.append(len(s))
                        vec.append(packed(point(s)))
                        sigs.append(signatures(s, key, times, percent).view(np.int64))
                    if len(seen) > 500_000:
                        seen.clear()
                    if cls:
                        sizes = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
                        yield pa.RecordBatch.from_pydict({
                            "cls": cls, "n": n, "vec": vec,
                            "sigs": pa.ListArray.from_arrays(sizes, np.concatenate(sigs)),
                        })

        return materialize(
            self.texts.select("text").mapInArrow(
                run, "cls long, n long, vec binary, sigs array<long>"
            ),
            "jaccard-signatures",
        )

    def members(self, signed: DataFrame) -> DataFrame:
        """(center, band, cls, n, size, hub): the trees with at least two members."""
        rows = signed.select("cls", "n", F.explode("sigs").alias("sig"))
        bucket = Window.partitionBy("sig")
        least, most = F.min("cls").over(bucket), F.max("cls").over(bucket)
        shared = (
            rows.withColumn("center", least).withColumn("_most", most)
            .where("center < _most").select("center", "cls", "n").distinct()
        )
        up = F.floor(F.log2(F.col("n") * 100 / self.percent + 1)).cast("int")
        bands = F.array_distinct(F.array(F.floor(F.log2("n")).cast("int"), up))
        placed = materialize(shared.withColumn("band", F.explode(bands)), "jaccard-members")
        sizes = (
            placed.groupBy("center", "band")
            .agg(F.count("*").alias("size"), F.min("cls").alias("hub")).where("size > 1")
        )
        return materialize(placed.join(sizes, ["center", "band"]), "jaccard-trees")

    def roots(
        self, rows: DataFrame, points: DataFrame, known: DataFrame | None = None
    ) -> DataFrame:
        """(node, root) after the links in the trees of ``rows`` (center, band, i, j, cls, asks)."""
        found = materialize(
            _survivors(rows.join(points, "cls").select(
                "center", "band", "i", "j", "cls", "asks", "n", "vec"
            ), self.percent),
            "jaccard-survivors",
        )
        # sets are long: first each class in one tree only, then the trees that still hold
        # classes which are not connected
        one = found.groupBy("cls").agg(F.min("center").alias("center"))
        known = components(self.verified(found.join(one, ["cls", "center"]), points), known)
        root = known.withColumnsRenamed({"node": "cls", "root": "r"})
        named = found.join(root, "cls", "left").withColumn("r", F.coalesce("r", "cls"))
        open_ = (
            named.groupBy("center", "band", "i", "j")
            .agg(F.min("r").alias("low"), F.max("r").alias("high")).where("low < high")
        )
        rest = named.join(open_, ["center", "band", "i", "j"], "left_semi").drop("r")
        rest = materialize(rest, "jaccard-open")
        return known if rest.isEmpty() else components(self.verified(rest, points), known)

    def verified(self, found: DataFrame, points: DataFrame) -> DataFrame:
        """Links among the rows (center, band, i, j, cls, asks), checked on the sets."""
        sets = self.sets(found.select("cls").distinct())
        whole = found.join(points, "cls").join(sets, "cls")
        return materialize(
            _verified(whole.select(
                "center", "band", "i", "j", "cls", "asks", "n", "vec", "shingles"
            ), self.percent),
            "jaccard-links",
        )

    def sets(self, classes: DataFrame) -> DataFrame:
        """(cls, shingles) of the given classes, from one document of each."""
        wanted = self.first.join(classes, "cls", "left_semi").withColumnRenamed("first", "_id")
        wanted = materialize(wanted, "jaccard-representatives")
        n, named = wanted.agg(F.count("*"), F.count("_id")).first()
        side = F.broadcast if n <= BROADCAST_IDS else (lambda df: df)
        ids = wanted.where("_id IS NOT NULL").select(F.col("_id").alias("id")).distinct()
        texts = self.texts.join(side(ids), "id", "left_semi")
        if named < n:
            texts = texts.union(self.texts.where("id IS NULL"))
        words = self.words

        def run(batch):
            for _, _, some in text_steps(batch.column(0)):
                sets = [shingle_set(word_hashes(t), words) for t in some]
                yield {
                    "cls": [_class(s) for s in sets], "shingles": [s.tobytes() for s in sets],
                }

        made = map_rows(texts.select("text"), run, "cls long, shingles binary")
        # ids may repeat on other texts, of other classes: each text comes once, whatever its id
        made = made.join(side(wanted.select("cls")), "cls", "left_semi")
        return made.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _first_round(trees: DataFrame, block: int) -> DataFrame:
    """Blocks of each tree, every one with the hub."""
    n = F.ceil(F.col("size") / block).cast("int")
    zero = F.lit(0)
    own = trees.select(
        "center", "band", F.pmod(F.xxhash64("cls"), n).cast("int").alias("i"),
        zero.alias("j"), "cls", F.lit(True).alias("asks"),
    )
    hubs = trees.where(n > 1).where("cls = hub").select(
        "center", "band", F.explode(F.sequence(zero, n - 1)).alias("i"),
        zero.alias("j"), "cls", F.lit(True).alias("asks"),
    )
    return own.union(hubs)


def _second_round(trees: DataFrame, root: DataFrame, block: int) -> DataFrame:
    """Members of large trees that no links join to the hub, with all other members."""
    large = trees.where(F.col("size") > block)
    root = root.withColumnsRenamed({"node": "cls", "root": "r"})
    hub = root.withColumnsRenamed({"cls": "hub", "r": "hub_r"})
    named = large.join(root, "cls", "left").join(hub, "hub", "left")
    apart = F.coalesce(F.col("r"), F.col("cls")) != F.coalesce(F.col("hub_r"), F.col("hub"))
    named = materialize(named.withColumn("apart", apart), "jaccard-apart")
    counts = named.where("apart").groupBy("center", "band").agg(F.count("*").alias("open"))
    named = named.join(counts, ["center", "band"])
    n = F.ceil(F.col("size") / block).cast("int")
    m = F.ceil(F.col("open") / block).cast("int")
    zero, salt = F.lit(0), F.xxhash64("cls")
    asking = named.where("apart").select(
        "center", "band", F.explode(F.sequence(zero, n - 1)).alias("i"),
        F.pmod(salt, m).cast("int").alias("j"), "cls", F.lit(True).alias("asks"),
    )
    asked = named.select(
        "center", "band", F.pmod(salt, n).cast("int").alias("i"),
        F.explode(F.sequence(zero, m - 1)).alias("j"), "cls", F.lit(False).alias("asks"),
    )
    return asking.union(asked)


def _most_frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """At most ``most`` rows: those from the least power of two that leaves no more."""
    stored = materialize(counts, "jaccard-frequent")
    sizes = stored.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()
    total, least = 0, 64
    for power, n in sorted(map(tuple, sizes), reverse=True):
        if total + n > most:
            break
        total, least = total + n, power
    return stored.where(F.col("n") >= F.lit(2**min(least, 62)))


def join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    percent: int = PERCENT, keep: list[str] | None = None, block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, component_id and component of each row, after its ``keep`` columns.

    ``component`` is the key of the linked group, for rows without ids, too; null without words.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = keep or []
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"_keep{k}") for k, c in enumerate(kept)], F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    names = rows.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    seen = materialize(_inspect(rows, names, fields, words), "jaccard-documents")
    docs = seen.where("kind = 0").drop("kind")
    often = _most_frequent(seen.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("n")))
    # copies meet here, summed up before they move
    first = materialize(
        docs.where("n > 0").groupBy("cls").agg(F.min("id").alias("first")), "jaccard-first"
    )
    search = _Search(texts, first, words, percent)
    signed = search.signed(often)
    points = materialize(
        signed.groupBy("cls").agg(F.first("n").alias("n"), F.first("vec").alias("vec")),
        "jaccard-points",
    )
    trees = search.members(signed)
    root = search.roots(_first_round(trees, block), points)
    if not trees.where(F.col("size") > block).isEmpty():
        root = search.roots(_second_round(trees, root, block), points, root)
    root = root.withColumnRenamed("node", "cls")
    named = first.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = materialize(named, "jaccard-classes")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(
        named.join(smallest, "root").select("cls", "component_id", F.col("root").alias("component")), "jaccard-components"
    )
    out = docs.join(classes, "cls", "left")
    return out.select(
        *[F.col(f"_keep{k}").alias(c) for k, c in enumerate(kept)], F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        "component",
    )
