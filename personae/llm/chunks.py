"""White-space chunks of a text, encoded once each and remembered.

The tokenizer of the files used here drops white space and never makes a token across it, so
the ids of a text are the ids of its chunks, one after the other. A memory holds what the
chunks of the last batches encode to; its size is bounded, and what it has forgotten is simply
encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

# What the tokenizer's \s matches, which is less than str.split() splits at.
_WIDE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")


class Splitter:
    """Cut a text into special tokens and white-space chunks.

    Special tokens are found first, in the raw text, longest first at each place.
    """

    def __init__(self, specials: dict[str, int]):
        self.specials = specials
        found = "|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))
        self._special = regex.compile(f"({found})") if specials else None

    @classmethod
    def from_file(cls, path: str) -> Splitter:
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        odd = [t for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if odd:
            raise ValueError(f"added tokens with matching rules are not supported: {odd}")
        return cls({t["content"]: t["id"] for t in added})

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not any(s in text for s in self.specials):
            small = _small(text)
            # a special token in capitals is none, and must not become one
            return _spaces(text if any(s in small for s in self.specials) else small)
        out: list[str] = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2:
                out.append(part)
            else:
                out += _spaces(part)
        return out


def _small(text: str) -> str:
    """Lower case, as far as it is a matter of single characters.

    The tokenizer lower-cases as well; done here, a word is remembered in one form.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _spaces(text: str) -> list[str]:
    if _ODD.search(text):
        return [c for c in _WIDE.split(text) if c]
    return text.split()


# Chunks that a worker remembers, in about 250 MB.
MEMORY = 1_200_000

# Ids of many chunks: one list for each, or all in one array and how many each has.
Encoded = list[list[int]] | tuple[np.ndarray, np.ndarray]


class _Codes(dict):
    """Chunk -> code; a new chunk gets the next code and is noted in ``new``."""

    new: list[str]

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.new.append(chunk)
        return code


class Memory:
    """Code of each chunk; ``ids`` and ``starts`` hold the ids of each code in one array."""

    def __init__(
        self, encode: Callable[[list[str]], Encoded], limit: int = MEMORY,
        note: Callable[[list[int]], object] | None = None,
    ):
        self._encode, self._limit, self._note = encode, limit, note
        self._reset()

    def _reset(self) -> None:
        self._code = _Codes()
        self.notes: list = []  # what ``note`` makes of the ids of each code
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1, np.int64)
        self._used = np.zeros(0, np.int64)
        self._round = 0

    def codes(self, texts: list[list[str]]) -> np.ndarray:
        """Codes of all chunks of ``texts``; valid until the next call."""
        self._round += 1
        if len(self._code) > self._limit:
            self._forget()
        self._code.new = []
        out = np.array(
            list(map(self._code.__getitem__, chain.from_iterable(texts))), np.int64
        )
        if self._code.new:
            self._add(self._encode(self._code.new))
        self._used[out] = self._round
        return out

    def code_of(self, chunk: str) -> int:
        return self._code[chunk]

    def _add(self, encoded: Encoded) -> None:
        if isinstance(encoded, tuple):
            flat, lengths = encoded
        else:
            flat = list(chain.from_iterable(encoded))
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        if self._note:
            self.notes += map(self._note, encoded)
        starts = self._starts[-1] + np.cumsum(lengths)
        end = int(starts[-1])
        if end > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros(max(end, 1 << 16), np.uint32)))
        self._ids[self._starts[-1] : end] = flat
        self._starts = np.concatenate((self._starts, starts))
        self._used = np.concatenate((self._used, np.zeros(len(lengths), np.int64)))

    def _forget(self) -> None:
        """Keep the chunks of the last batches, at most half of the limit."""
        recent = np.sort(self._used)[-min(len(self._used), self._limit // 2)]
        kept = np.flatnonzero(self._used > recent)
        ids, counts = self.gather(kept)
        place = np.full(len(self._used), -1)
        place[kept] = np.arange(len(kept))
        new = place.tolist()
        code = _Codes((c, new[k]) for c, k in self._code.items() if new[k] >= 0)
        notes = [self.notes[k] for k in kept.tolist()] if self._note else []
        used, round_now = self._used[kept], self._round
        self._reset()
        self._code, self.notes, self._used, self._round = code, notes, used, round_now
        self._starts = np.concatenate(([0], np.cumsum(counts)))
        self._ids = np.concatenate((ids, self._ids))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``codes`` in order, and how many each code has."""
        start = self._starts[codes]
        count = self._starts[codes + 1] - start
        ends = np.cumsum(count)
        shift = np.repeat(start - (ends - count), count)
        return self._ids[shift + np.arange(len(shift))], count

    def counts(self, codes: np.ndarray) -> np.ndarray:
        return self._starts[codes + 1] - self._starts[codes]


# Closes a text among the chunks of many; the one chunk that is not encoded.
_CLOSE = "\x00\x01close\x01\x00"


class TokenStream:
    """Ids of whole texts through a memory, a bounded number of characters at a time.

    The texts of a call are split as one, which is the same where no text holds a special token
    or a character that the tokenizer lower-cases in its own way; else they are split one by one.
    """

    def __init__(
        self, splitter: Splitter, encode: Callable[[list[str]], list[list[int]]],
        limit: int = MEMORY, end: int | None = None,
    ):
        self.splitter, self._tool = splitter, encode
        self._end = [] if end is None else [end]
        self.memory = Memory(self._encode, limit)

    def _encode(self, chunks: list[str]) -> Encoded:
        """Ids of chunks, encoded as one text with a special token as border between them."""
        close = chunks.index(_CLOSE) if _CLOSE in chunks else None
        plain = ["" if c == _CLOSE else c for c in chunks] if close is not None else chunks
        border = next((s for s in self.splitter.specials if s not in plain), None)
        if border is None:
            each = self._tool(plain)
            ids = np.fromiter(chain.from_iterable(each), np.uint32)
            counts = np.fromiter(map(len, each), np.int64, len(each))
        else:
            ids = np.array(self._tool([border.join(plain)])[0], np.uint32)
            there = np.flatnonzero(ids == self.splitter.specials[border])
            counts = np.diff(there, prepend=-1, append=len(ids)) - 1
            ids = np.delete(ids, there)
        if close is not None:
            ids = np.insert(ids, counts[:close].sum(), self._end).astype(np.uint32)
            counts[close] = len(self._end)
        return ids, counts

    def _chunks(self, texts: list[str | None]) -> list[str]:
        joined = f" {_CLOSE} ".join([t or "" for t in texts]) + f" {_CLOSE}"
        if joined.count(_CLOSE) == len(texts):
            small = _small(joined)
            plain = small is not joined or joined.isascii()
            if plain and not any(s in small for s in self.splitter.specials):
                return _spaces(small)
        out: list[str] = []
        for text in texts:
            # the mark itself in a text: no token goes from its signs to its letters
            own = self.splitter((text or "").replace(_CLOSE, "\x00\x01 close\x01\x00"))
            out += own
            out.append(_CLOSE)
        return out

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all chunks, and the number of ids of each text, its end included."""
        codes = self.memory.codes([self._chunks(texts)])
        ends = np.flatnonzero(codes == self.memory.code_of(_CLOSE)) + 1
        lengths = np.concatenate(([0], np.cumsum(self.memory.counts(codes))))
        return codes, np.diff(lengths[ends], prepend=0)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        return self._codes(texts)[1] if texts else np.zeros(0, np.int64)

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each text's end included, and their numbers."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes, counts = self._codes(texts)
        return self.memory.gather(codes)[0], counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, counts = self.flat(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []
