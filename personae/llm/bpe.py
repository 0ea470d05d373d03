"""BPE encoding and decoding with a pair occurrence index.

The chunks that a task meets for the first time are laid out together as one linked list of
symbols. An index maps the rank of every mergeable adjacent pair to all its positions, over
all those chunks at once. The active ranks are applied in ascending order: each takes its
whole list of positions from left to right, joins the pairs that are still there, and files
the two pairs that each join creates under their own ranks. A rank is finished when its list
has been worked through, as a pair that holds the new symbol can only have a higher rank; the
vocabulary is checked for that when it is loaded.

Input is a tokenizer file of the `tokenizers` library with a byte-level BPE model: NFC, lower
case by character, white space dropped, words cut by the file's pattern, an end-of-word
suffix. Encoding equals that library's without special tokens added (special tokens that
occur in a text keep their own ids); decoding equals its ``decode`` without a decoder, tokens
joined by a blank, special tokens included. No tokenizer is run or trained here.

Defined cases: null and empty text have no ids and decode to empty text. Repeated and null
ids are treated row by row, other columns ignored. A text of any length is one row.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.llm.batches import map_rows, steps, text_steps
from personae.llm.chunks import Memory, Splitter


# Words whose ids a worker remembers: the last half, and what is left of the half before.
WORDS = 800_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for 256 and up, in order.
    """
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """Symbols, merges and word pattern of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unsupported tokenizer file: {model['type']}, {normal}")
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the pattern must name what is kept")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self._words = regex.compile(split["pattern"]["Regex"] + "|\n")
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.rank: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        made = {i for i in (*self.inner, *self.last)}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if a not in made or b not in made:
                raise ValueError(f"merge {rank} uses a symbol that no earlier merge makes")
            made.add(c)
            self.rank.setdefault(a << 32 | b, rank)
            self.merges.append((a, b, c))
        pairs = sorted(self.rank.items())
        self._keys = np.array([k for k, _ in pairs], np.int64)
        self._ranks = np.array([r for _, r in pairs], np.int64)
        self.tokens = {i: t for t, i in vocab.items()} | {
            t["id"]: t["content"] for t in spec["added_tokens"]
        }

    def cut(self, chunks: list[str]) -> list[list[str]]:
        """Words of each chunk after normalization; every chunk has one at least."""
        text = "\n".join(chunks)
        if not text.isascii():
            # one character at a time, so that no letter's form depends on its neighbours
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        out: list[list[str]] = [[]]
        for word in self._words.findall(text.lower()):
            if word == "\n":
                out.append([])
            else:
                out[-1].append(word)
        return out if chunks else []

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by the pair occurrence index over all of them."""
        rank, merges = self.rank, self.merges
        if not words:
            return []
        data = [word.encode() for word in words]
        joined = b"".join(data)
        size, ends = len(joined), np.cumsum([len(d) for d in data])
        first = ends - np.array([len(d) for d in data])
        symbol = list(map(self.inner.__getitem__, joined))
        after_all, before_all = np.arange(1, size + 1), np.arange(-1, size - 1)
        after_all[ends - 1] = before_all[first] = -1
        for at in (ends - 1).tolist():
            symbol[at] = self.last[joined[at]]
        index = self._positions(symbol, after_all)
        after, before = after_all.tolist(), before_all.tolist()
        active = list(index)
        heapq.heapify(active)
        find, known, push = rank.get, index.get, heapq.heappush
        while active:
            r = heapq.heappop(active)
            a, b, c = merges[r]
            places = index.pop(r)
            if len(places) > 1:
                places.sort()
            for p in places:
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = c, -1
                after[p] = n = after[q]
                if n >= 0:
                    before[n] = p
                    new = find(c << 32 | symbol[n])
                    if new is not None:
                        if (filed := known(new)) is not None:
                            filed.append(p)
                        else:
                            index[new] = [p]
                            push(active, new)
                if (m := before[p]) >= 0:
                    new = find(symbol[m] << 32 | c)
                    if new is not None:
                        if (filed := known(new)) is not None:
                            filed.append(m)
                        else:
                            index[new] = [m]
                            push(active, new)
        left = np.concatenate(([0], np.cumsum(np.array(symbol) >= 0)))
        ids = [s for s in symbol if s >= 0]
        return [
            ids[at:end] for at, end in zip(left[first].tolist(), left[ends].tolist(), strict=True)
        ]

    def _positions(self, symbol: list[int], right: np.ndarray) -> dict[int, list[int]]:
        """Rank of each adjacent pair that can be merged -> its positions, ascending."""
        s = np.array(symbol, np.int64)
        p = np.flatnonzero(right >= 0)
        key = s[p] << 32 | s[right[p]]
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        p, r = p[self._keys[at] == key], self._ranks[at[self._keys[at] == key]]
        order = np.argsort(r, kind="stable")
        p, r = p[order], r[order]
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        places, ends = p.tolist(), np.append(starts, len(p))[1:].tolist()
        return {
            k: places[at:end]
            for k, at, end in zip(r[starts].tolist(), starts.tolist(), ends, strict=True)
        }


class Codec:
    """Encode and decode with one vocabulary file; remembers recent chunks."""

    def __init__(self, path: str):
        self.vocabulary, self.splitter = Vocabulary(path), Splitter.from_file(path)
        self.memory = Memory(self._encode_chunks, 500_000, self._written)
        self._words: dict[str, list[int]] = {}
        self._older: dict[str, list[int]] = {}  # words of the time before, until they come again

    def _written(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        special = self.splitter.specials
        cut = self.vocabulary.cut([c for c in chunks if c not in special])
        if len(self._words) > WORDS // 2:
            self._older, self._words = self._words, {}
        known, older = self._words, self._older
        missing = set(chain.from_iterable(cut)).difference(known)
        again = missing.intersection(older) if older else ()
        known.update(zip(again, map(older.pop, again), strict=True))
        new = list(missing.difference(again))
        if new:
            known.update(zip(new, self.vocabulary.merge(new), strict=True))
        ids = iter(cut)
        return [
            [special[c]] if c in special else [i for w in next(ids) for i in known[w]]
            for c in chunks
        ]

    def written(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids of each text, the ids and the decoded text written out."""
        with _uncollected():
            return self._written_texts(texts)

    def _written_texts(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        out = []
        for i, j in steps(texts):
            chunks = [self.splitter(t) for t in texts[i:j]]
            codes = self.memory.codes(chunks)
            counts, codes = self.memory.counts(codes), codes.tolist()
            notes, at = self.memory.notes, 0
            for own in chunks:
                got = [notes[c] for c in codes[at : at + len(own)]]
                n = int(counts[at : at + len(own)].sum())
                at += len(own)
                out.append((n, " ".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out = []
        for i, j in steps(texts):
            chunks = [self.splitter(t) for t in texts[i:j]]
            codes = self.memory.codes(chunks)
            at = 0
            for own in chunks:
                out.append(self.memory.gather(codes[at : at + len(own)])[0].tolist())
                at += len(own)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a blank; ids outside the vocabulary are left out."""
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@contextmanager
def _uncollected():
    """Without searches for cycles, which what is remembered has none of but would lengthen."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@cache
def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path)


def encode(
    df: DataFrame, path: str, text_col: str = "text", keep: list[str | Column] | None = None
) -> DataFrame:
    """``keep`` columns of each row with ``ids array<int>``."""
    kept = df.select(*(keep or []), F.col(text_col).alias("_text"))
    names = kept.columns[:-1]

    def run(batch):
        for i, j, texts in text_steps(batch.column(len(names))):
            yield {n: batch.column(k)[i:j] for k, n in enumerate(names)} | {
                "ids": pa.array(codec(path).encode(texts), pa.list_(pa.int32()))
            }

    return map_rows(kept, run, _schema(kept) + "ids array<int>")


def decode(
    df: DataFrame, path: str, ids_col: str = "ids", keep: list[str | Column] | None = None
) -> DataFrame:
    """``keep`` columns of each row with the text that ``ids_col`` decodes to."""
    kept = df.select(*(keep or []), F.col(ids_col).alias("_ids"))
    names = kept.columns[:-1]

    def run(batch):
        yield {n: batch.column(k) for k, n in enumerate(names)} | {
            "decoded": [codec(path).decode(ids or []) for ids in batch.column(len(names)).to_pylist()]
        }

    return map_rows(kept, run, _schema(kept) + "decoded string")


def digests(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token count, and SHA-256 of the ids and of the text they decode to.

    Encodes and decodes in one pass, so that neither ids nor text leave the task.
    """
    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batch):
        for i, j, texts in text_steps(batch.column(1)):
            done = codec(path).written(texts)
            yield {
                "doc_id": batch.column(0)[i:j], "n_tokens": [n for n, _, _ in done],
                "ids_sha256": [_sha(ids) for _, ids, _ in done],
                "decoded_sha256": [_sha(text) for _, _, text in done],
            }

    return map_rows(
        kept, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _schema(kept: DataFrame) -> str:
    fields = kept.schema.fields[:-1]
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
