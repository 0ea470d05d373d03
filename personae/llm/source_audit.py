"""Divergence of sources: exact term frequencies by single-pass in-memory indexing.

A term is a maximal run of letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased.
A document belongs to the group of its language and source (null: empty text).

1. Every task reads its documents once into block postings in memory, term -> (group, occurrences,
   documents). When they hold ``MEMORY`` postings, the block is spilled as a run: sorted by hash
   shard and term, cut into pieces of ``PIECE`` postings, and memory is empty again.
2. A shard gets the pieces of all runs, in order of their first terms. It merges them with a heap
   that opens a piece when its first term is due, so one piece of each run is in memory. What
   comes out are frequencies by term and group. Terms in at least ``least`` documents of a
   language are kept.
3. With c occurrences in a group, p = 1 + floor(10^9 (c + 2) / (N + 2 V)). The divergence of two
   groups is the sum of f = floor((p - q)^2 / (p + q)) over all V kept terms of the language. It is
   V f(0, 0), corrected by what every term of one group adds against a zero of the other (summed
   by distinct p, as these are few), and, streaming over the terms, by what terms of both groups
   add beyond that. Tasks sum pair corrections by pair of groups before anything is sent.

All of it is exact whole numbers: shares are divided three digits at a time, so that nothing leaves
a long up to 9 * 10^15 occurrences in a language.

Scale: documents never travel, only postings, and one task's postings of a term and group are
one. A source or language with any share of the rows is a bounded number of postings for each run.
No table is broadcast by hand; joins by language are salted where it is hot. The result has a row
for each pair of groups of a language, and so has the work on pairs.

Defined cases: null text, language or source are empty; a group without terms takes part, with
p from zeros (V = 0: values 0, no term rows). Repeated documents and ids count as often as they
occur; very long texts are cut between terms and worked on piece by piece. An empty table gives
no row. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personae.operators.scale import materialize, skew_join

MEMORY = 400_000
PIECE = 4_096
PAIRS = 1 << 19
SLICE = 1 << 22

# every byte of a term as itself in lower case, all others as a blank
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_RUN = (
    "shard int, first binary, terms binary, sizes binary, groups binary, counts binary, "
    "docs binary, langs array<string>, sources array<string>"
)


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end between terms."""
    at = 0
    while len(data) - at > SLICE:
        gap = _GAP.search(data, at + SLICE)
        end = gap.end() if gap else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    for part in _slices(data):
        yield part.translate(_FOLD).split()


class _Postings:
    """Block postings of one task. A group is present even if it has no term."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, group: tuple[str, str], data: bytes) -> None:
        parts = terms(data)
        first = next(parts)
        seen = set(first)
        self.counts[group].update(first)
        for part in parts:
            self.counts[group].update(part)
            seen.update(part)
        self.docs[group].update(seen)

    def size(self) -> int:
        return sum(map(len, self.docs.values()))

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The postings as pieces, by shard and term; a group itself is the posting of no term."""
        names = sorted(self.docs)
        words, group, count, docs = [b""] * len(names), [np.arange(len(names))], [], []
        zero = np.zeros(len(names), np.int64)
        count.append(zero)
        docs.append(zero)
        for g, name in enumerate(names):
            own = self.docs.pop(name)
            many = self.counts.pop(name)
            words += own
            group.append(np.full(len(own), g))
            count.append(np.fromiter(map(many.__getitem__, own), np.int64, len(own)))
            docs.append(np.fromiter(own.values(), np.int64, len(own)))
        group, count, docs = (np.concatenate(c) for c in (group, count, docs))
        shard = np.fromiter((crc32(w) % shards for w in words), np.int64, len(words))
        alphabetic = pc.array_sort_indices(pa.array(words, pa.large_binary())).to_numpy()
        order = alphabetic[np.argsort(shard[alphabetic], kind="stable")]
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            for at in range(cuts[s], cuts[s + 1], PIECE):
                yield _piece(s, words, group, count, docs, order[at : min(at + PIECE, cuts[s + 1])],
                             names)


def _piece(shard, words, group, count, docs, own, names) -> pa.RecordBatch:
    text = [words[i] for i in own]
    new = np.array([True] + [a != b for a, b in zip(text, text[1:], strict=False)])
    starts = np.flatnonzero(new)
    used, local = np.unique(group[own], return_inverse=True)
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "first": [text[0]],
        "terms": [b" ".join([text[i] for i in starts])],
        "sizes": [np.diff(np.append(starts, len(own))).astype(np.int32).tobytes()],
        "groups": [local.astype(np.int32).tobytes()], "counts": [count[own].tobytes()],
        "docs": [docs[own].tobytes()],
        "langs": [[names[g][0] for g in used]], "sources": [[names[g][1] for g in used]],
    })


def _runs(docs: DataFrame, shards: int, memory: int) -> DataFrame:
    def run(batches):
        block = _Postings()
        for batch in batches:
            for i in range(batch.num_rows):
                text, lang, source = (batch.column(c)[i].as_py() for c in range(3))
                block.add((lang, source), text)
                if i % 64 == 0 and block.size() > memory:
                    yield from block.run(shards)
            if block.size() > memory:
                yield from block.run(shards)
        if block.docs:
            yield from block.run(shards)

    return docs.mapInArrow(run, _RUN)


class _Piece:
    """An open piece of a run, at one of its terms."""

    def __init__(self, batch: pa.RecordBatch, i: int, groups: dict[tuple[str, str], int]):
        get = lambda name: batch.column(name)[i].as_py()
        self.terms = get("terms").split(b" ")
        ends = np.cumsum(np.frombuffer(get("sizes"), np.int32))
        self.ends, self.at = [0, *ends.tolist()], 0
        names = zip(get("langs"), get("sources"), strict=True)
        known = np.array([groups.setdefault(n, len(groups)) for n in names], np.int64)
        self.groups = known[np.frombuffer(get("groups"), np.int32)]
        self.counts = np.frombuffer(get("counts"), np.int64)
        self.docs = np.frombuffer(get("docs"), np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merge the pieces of one shard, which come in order of their first terms."""
    groups: dict[tuple[str, str], int] = {}
    heap: list[tuple[bytes, int, _Piece]] = []
    words: list[bytes] = []
    taken: list[tuple[int, _Piece, int, int]] = []  # number of the term, postings of a piece
    number = held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        term = np.repeat([t for t, _, _, _ in taken], [b - a for _, _, a, b in taken])
        parts = [
            np.concatenate([getattr(p, name)[a:b] for _, p, a, b in taken])
            for name in ("groups", "counts", "docs")
        ]
        yield from _kept(words, groups, term, *parts, least)
        words.clear()
        taken.clear()
        held = 0

    def upto(first: bytes | None) -> Iterator[pa.RecordBatch]:
        """Take all terms before ``first``: no later piece holds them."""
        nonlocal number, held
        while heap and (first is None or heap[0][0] < first):
            word, order, piece = heap[0]
            if not words or words[-1] != word:
                if held > 16 * PIECE:
                    yield from flush()
                words.append(word)
            a, b = piece.ends[piece.at], piece.ends[piece.at + 1]
            taken.append((len(words) - 1, piece, a, b))
            held += b - a
            piece.at += 1
            if piece.at < len(piece.terms):
                heapq.heapreplace(heap, (piece.terms[piece.at], order, piece))
            else:
                heapq.heappop(heap)

    for batch in batches:
        for i in range(batch.num_rows):
            yield from upto(batch.column("first")[i].as_py())
            piece = _Piece(batch, i, groups)
            number += 1
            heapq.heappush(heap, (piece.terms[0], number, piece))
    yield from upto(None)
    if taken:
        yield from flush()


def _kept(words, groups, term, group, count, docs, least: int) -> Iterator[pa.RecordBatch]:
    """Frequencies of whole terms: those with ``least`` documents, and the groups themselves."""
    names = list(groups)
    langs: dict[str, int] = {}
    lang_of = np.array([langs.setdefault(lang, len(langs)) for lang, _ in names], np.int64)
    key = term * len(names) + group
    order = np.argsort(key, kind="stable")
    key, starts = np.unique(key[order], return_index=True)
    count, docs = (np.add.reduceat(c[order], starts) for c in (count, docs))
    term, group = key // len(names), key % len(names)
    per_lang, place = np.unique(term * len(langs) + lang_of[group], return_inverse=True)
    total, spread = np.zeros((2, len(per_lang)), np.int64)
    np.add.at(total, place, count)
    np.add.at(spread, place, docs)
    mark = np.array([not w for w in words])[term]
    own = np.flatnonzero(mark | (spread[place] >= least))
    if len(own):
        text = pa.array([words[t].decode("utf-8", "surrogatepass") or None for t in term[own]],
                        pa.string())
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([names[g][0] for g in group[own]], pa.string()),
            "source": pa.array([names[g][1] for g in group[own]], pa.string()),
            "term": text, "count": count[own], "lang_count": total[place][own],
        })


def frequencies(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least: int = 10, memory: int = MEMORY,
) -> DataFrame:
    """Stored (lang, source, term, count, lang_count) of kept terms; term null: the group itself.

    A group occurs once without a term, whatever its texts.
    """
    spark = df.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = F.lit("")
    docs = df.select(
        F.coalesce(F.col(text_col), empty).cast("binary").alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
    )
    pieces = _runs(docs, shards, memory).repartitionById(shards, F.col("shard"))
    merged = pieces.sortWithinPartitions("first").mapInArrow(
        lambda batches: _frequencies(batches, least),
        "lang string, source string, term string, count long, lang_count long",
    )
    return materialize(merged, "term-frequencies")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) for 0 <= count <= total, in longs.

    ``total`` = 0 has a share of 1.
    """
    whole = F.greatest(total, F.lit(1).cast("long"))
    digits, rest = F.call_function("div", count, whole), count % whole
    for _ in range(3):
        digits, rest = digits * 1000 + F.call_function("div", rest * 1000, whole), rest * 1000 % whole
    return F.when(total > 0, 1 + digits).otherwise(F.lit(1).cast("long"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(postings: DataFrame) -> DataFrame:
    """(a, b, value) for a < b: what terms of both groups add beyond the parts of each.

    ``postings`` (lang, term, gid, p, p0) become whole terms by a shuffle; a term has one row for
    each group, however often it occurs.
    """
    def run(batches):
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        open_: list[tuple[tuple[str, str], list[np.ndarray]]] = []  # the last, unfinished term

        def merged():
            a, b, v = (np.concatenate(c) for c in zip(*sums, strict=True))
            order = np.lexsort((b, a))
            a, b, v = a[order], b[order], v[order]
            new = np.flatnonzero(
                np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            )
            return a[new], b[new], np.add.reduceat(v, new)

        def flush():
            a, b, v = merged()
            sums.clear()
            return pa.RecordBatch.from_pydict({"a": a, "b": b, "value": v})

        def add(gid, p, p0, end):
            """Sum up the pairs of row i with the rows up to ``end[i]``."""
            nonlocal size
            partners = end - np.arange(len(gid)) - 1
            reach = np.cumsum(partners)
            row = 0
            while row < len(gid):
                before = int(reach[row - 1]) if row else 0
                last = max(row + 1, int(np.searchsorted(reach, before + PAIRS, "right")))
                n = partners[row:last]
                left = np.repeat(np.arange(row, last), n)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                row = last
                if not len(left):
                    continue
                value = (
                    _gap(p[left], p[right]) - _gap(p[left], p0[right])
                    - _gap(p0[left], p[right]) + _gap(p0[left], p0[right])
                )
                sums.append((gid[left], gid[right], value))
                size += len(left)
                if size > PAIRS:
                    sums[:] = [merged()]
                    size = len(sums[0][0])
                    if size > PAIRS // 2:
                        yield flush()
                        size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term = batch.column(0), batch.column(1)
            columns = [batch.column(c).to_numpy() for c in (2, 3, 4)]
            differs = pc.or_(
                pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])
            ).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(differs) + 1))
            name = (lang[0].as_py(), term[0].as_py())
            if open_ and open_[0][0] == name:
                columns = [np.concatenate(c) for c in zip(open_[0][1], columns, strict=True)]
                starts[1:] += len(columns[0]) - batch.num_rows
            elif open_:
                k = len(open_[0][1][0])
                yield from add(*open_[0][1], np.full(k, k))
            open_.clear()
            cut = int(starts[-1])  # the last term may go on in the next batch
            last = (lang[batch.num_rows - 1].as_py(), term[batch.num_rows - 1].as_py())
            open_.append((last, [c[cut:] for c in columns]))
            if cut:
                end = np.repeat(starts[1:], np.diff(starts))
                yield from add(*[c[:cut] for c in columns], end)
        if open_:
            k = len(open_[0][1][0])
            yield from add(*open_[0][1], np.full(k, k))
        if sums:
            yield flush()

    placed = postings.repartition("lang", "term").sortWithinPartitions("lang", "term", "gid")
    return placed.mapInArrow(run, "a long, b long, value long").groupBy("a", "b").agg(
        F.sum("value").alias("value")
    )


def audit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least: int = 10, top: int = 10, memory: int = MEMORY,
) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by divergence, and top terms."""
    table = frequencies(df, text_col, lang_col, source_col, least, memory)
    terms_of = table.where("term is not null")
    langs = terms_of.groupBy("lang").agg(
        F.count_distinct("term").alias("v"), F.sum("count").alias("lang_n")
    )
    sums = table.groupBy("lang", "source").agg(
        F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("count"))), F.lit(0)).alias("n")
    )
    zero = F.lit(0).cast("long")
    groups = sums.join(langs, "lang", "left").select(
        "lang", "source", "n", F.coalesce("v", zero).alias("v"),
        F.coalesce("lang_n", zero).alias("lang_n"), F.monotonically_increasing_id().alias("gid"),
    )
    groups = groups.withColumn("p0", share(F.lit(2).cast("long"), F.col("n") + 2 * F.col("v")))
    groups = materialize(groups, "groups")
    known = terms_of.join(groups, ["lang", "source"]).withColumn(
        "p", share(F.col("count") + 2, F.col("n") + 2 * F.col("v"))
    )
    known = materialize(known, "term-shares")

    q = share(F.col("lang_count") + 2, F.col("lang_n") + 2 * F.col("v"))
    best = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    by_term = (
        known.withColumn("q", q).where("p > q")
        .select("lang", "source", "gid", F.col("term").alias("item"),
                gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )

    # what the terms of a, by distinct p, add against a zero of every other group b
    levels = known.groupBy("lang", "gid", "p", "p0").agg(F.count("*").alias("times"))
    levels = levels.withColumnsRenamed({"gid": "a", "p0": "a0"})
    other = groups.select("lang", F.col("gid").alias("b"), F.col("p0").alias("b0"))
    against = skew_join(materialize(levels, "share-levels"), other, ["lang"], ["a", "p"], "inner")
    single = against.where("a <> b").groupBy("a", "b").agg(
        F.sum(F.col("times") * (gap(F.col("p"), F.col("b0")) - gap(F.col("a0"), F.col("b0"))))
        .alias("single")
    )
    both = _corrections(known.select("lang", "term", "gid", "p", "p0"))
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    corrected = (
        single.select(low, high, F.col("single").alias("value"))
        .unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("more"))
    )
    # one row for each pair of groups of a language: the result itself
    mine = groups.select("lang", "source", "v", F.col("gid").alias("x"), F.col("p0").alias("x0"))
    theirs = groups.select(
        "lang", F.col("source").alias("item"), F.col("gid").alias("y"), F.col("p0").alias("y0")
    )
    pairs = skew_join(mine, theirs, ["lang"], "x", "inner").where("x <> y").select(
        "lang", "source", "item", "x", F.least("x", "y").alias("a"),
        F.greatest("x", "y").alias("b"),
        (F.col("v") * gap(F.col("x0"), F.col("y0"))).alias("base"),
    )
    order = Window.partitionBy("x").orderBy(F.desc("value"), "item")
    by_pair = (
        pairs.join(corrected, ["a", "b"], "left")
        .withColumn("value", F.col("base") + F.coalesce("more", zero))
        .withColumn("rank", F.row_number().over(order))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    )
    return by_pair.unionByName(by_term)
