"""Personal data: fixed patterns, and a character-level tagger for what they miss.

Base patterns (``BASE``), leftmost and not overlapping within a kind: e-mail addresses, IPv4
addresses, card numbers that pass Luhn's test, and international phone numbers.

The tagger (``tagger``: bidirectional LSTM, CRF transitions) learns from labelled spans: the base
spans of a sample of windows, as they are and rewritten in ways the patterns do not know (numbers
without "+", other separators, "(at)" and "dot" written out), against windows without spans and
windows with dates, prices, versions and counts. It reads every character of every text, in
passages of ``PASSAGE`` characters that overlap by ``OVERLAP``, so that each place is read with what
is around it; each passage is decoded by itself (Viterbi). For a whole document the spans of all
passages are then reconciled: pieces cut at an edge are joined with their other half, and of spans
that overlap the set with the largest sum of margins stays. What has a margin below ``MARGIN``, or
not the digits or signs that its kind needs, or meets a base span is dropped. The rest are kinds
``model_...``.

Training is bounded: each task keeps the ``SAMPLE`` windows with the smallest hashes, of each of
three classes, and so does the whole. Windows of ``WIDTH`` characters within ``REACH`` of a digit or
"@" hold base spans or none; windows of text without either sign are the third class. Scanning
takes whole texts, in time linear in their length.

Defined cases: null text is empty and has no spans; offsets are code points, ends exclusive;
repeated or null ids are scanned row by row; without a base span in the training rows the tagger
adds nothing. Columns in ``keep`` may have any name but ``text`` and ``spans``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.llm import tagger
from personae.llm.batches import judged, text_steps
from personae.operators.scale import materialize

BASE = ["email", "ip", "card", "phone"]
KINDS = BASE + [f"model_{k}" for k in BASE]
REACH = 31
WIDTH = 128
PASSAGE = 1024
OVERLAP = 64
CELLS = 1 << 20
SAMPLE = 1_500
MARGIN = 4.0
CHARS = 800_000  # that are scanned at a time: their passages make one matrix
SHORT = 300  # characters that the patterns read sooner than numpy looks for digits

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match never ends within digits, so none starts there: no need to try
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NEAR = re.compile(rf"[0-9@](?:[^0-9@]{{0,{2 * REACH + 1}}}+[0-9@])*+")
_DIGIT = re.compile(r"[0-9]")
_SPAN = "struct<start:int,kind:int,end:int>"

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _byte(part: str) -> bool:
    """At most 255, whatever zeros come first."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _points(text: str) -> np.ndarray:
    """One byte for each code point; those beyond Latin-1 are question marks."""
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def _holds(text: str) -> tuple[bool, bool]:
    """Whether an address may be in the text, and a card number, by where its digits are."""
    if len(text) < SHORT:
        return True, True
    points = _points(text)
    at = np.flatnonzero(points - np.uint8(ord("0")) < 10)
    card = bool((at[13:] - at[:-13] <= 26).any())  # 14 digits with one sign between them at most
    steps = np.diff(at)
    ends = np.flatnonzero(steps > 1)  # three in a row are single dots
    dots = (steps[ends] == 2) & (points[at[ends] + 1] == ord("."))
    return bool((dots[2:] & dots[1:-1] & dots[:-2]).any()), card


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns that hold, by kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), 0))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    address, card = _holds(text)
    for m in _IP.finditer(text) if address else ():
        if all(map(_byte, m.group().split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text) if card else ():
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return out


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The text within ``REACH`` of a digit or "@"."""
    for m in _NEAR.finditer(text):
        yield max(0, m.start() - REACH), min(len(text), m.end() + REACH)


def windows(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, cut at its start, cut at its end) of overlapping windows."""
    for a, b in stretches(text):
        at = a
        while True:
            end = min(b, at + WIDTH)
            yield at, end, at > a, end < b
            if end == b:
                break
            at += WIDTH // 2


def passages(text: str, width: int = PASSAGE) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, cut at its start, cut at its end) of overlapping parts of the whole text."""
    at = 0
    while at < len(text):
        end = min(len(text), at + width)
        yield at, end, at > 0, end < len(text)
        at = end if end == len(text) else end - OVERLAP


def plain(text: str, width: int = WIDTH) -> np.ndarray:
    """Starts of the passages of that width that hold neither digit nor "@"."""
    points = _points(text)
    signs = np.flatnonzero((points - np.uint8(ord("0")) < 10) | (points == ord("@")))
    starts = np.arange(0, max(len(text) - OVERLAP, min(1, len(text))), width - OVERLAP)
    return starts[np.searchsorted(signs, starts) == np.searchsorted(signs, starts + width)]


def reconciled(found: list[tuple[int, int, int, float, bool]]) -> list[Span]:
    """The best spans that do not overlap, from (start, end, kind, margin, cut) of all windows."""
    joined: list[list] = []
    for start, end, kind, margin, cut in sorted(found):
        for other in reversed(joined[-4:]):
            same = other[:3] == [start, end, kind]
            if same or other[2] == kind and start < other[1] and (cut or other[4]):
                other[1], other[4] = max(end, other[1]), other[4] and cut
                other[3] = max(margin, other[3])
                break
        else:
            joined.append([start, end, kind, margin, cut])
    spans = sorted((s for s in joined if s[3] >= MARGIN), key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in spans]
    best = [0.0]
    for i, (start, _, _, margin, _) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], start, "right"))
        best.append(max(best[i], best[before] + margin))
    out, i = [], len(spans)
    while i:
        start, end, kind, margin, _ = spans[i - 1]
        if best[i] > best[i - 1]:
            out.append((start, end, kind))
            i = int(np.searchsorted(ends[: i - 1], start, "right"))
        else:
            i -= 1
    return out[::-1]


def plausible(text: str, kind: int) -> bool:
    """The span holds what its kind needs."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.search(r"\w\W*(@|\bat\b)\W*\w.*(\.|dot)\W*\w", text))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(_byte, parts))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _alike(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of passages of rising lengths that make a matrix of at most ``CELLS``, one at least."""
    start = 0
    for i, n in enumerate(lengths):
        if i > start and (i + 1 - start) * n > CELLS:
            yield start, i
            start = i
    if lengths:
        yield start, len(lengths)


class Model:
    """The tagger, or none if there was nothing to learn."""

    def __init__(self, net: tagger.Tagger | None):
        self.net = net

    def added(self, texts: list[str]) -> list[list[Span]]:
        """Reconciled spans of the tagger alone, of kinds in ``BASE``."""
        if self.net is None:
            return [[] for _ in texts]
        places = [(i, *w) for i, text in enumerate(texts) for w in passages(text)]
        places.sort(key=lambda p: p[2] - p[1])
        points = [tagger.codes(text) for text in texts]
        found: list[list[tuple]] = [[] for _ in texts]
        for i, j in _alike([b - a for _, a, b, _, _ in places]):
            some = places[i:j]
            x, inside = tagger.filled([points[i][a:b] for i, a, b, _, _ in some])
            path, above = self.net.decode(x, inside)
            for k in np.flatnonzero(path.any(axis=1)):
                i, a, b, first, last = some[k]
                for start, end, kind, margin in self.net.spans(path[k, : b - a], above[k]):
                    cut = first and start == 0 or last and end == b - a
                    found[i].append((a + start, a + end, kind, margin, cut))
        return [reconciled(f) if f else [] for f in found]

    def scan(self, texts: list[str]) -> list[list[Span]]:
        """All spans, of kinds in ``KINDS``, in order of start and kind."""
        out = []
        for text, extra in zip(texts, self.added(texts), strict=True):
            spans = base_spans(text)
            taken = sorted(spans)
            firsts = [s[0] for s in taken]
            reach = np.maximum.accumulate([s[1] for s in taken]) if taken else []
            for start, end, kind in extra:
                before = int(np.searchsorted(firsts, end))
                if before and reach[before - 1] > start or not plausible(text[start:end], kind):
                    continue
                spans.append((start, end, kind + len(BASE)))
            out.append(sorted(spans, key=lambda s: (s[0], s[2], s[1])))
        return out


_ROWS = "label int, hash long, text string, spans array<int>"


def _examples(batches: Iterator[pa.RecordBatch], sample: int) -> Iterator[pa.RecordBatch]:
    """The windows with the smallest hashes, with base spans, without, and far from any sign.

    Each text comes once.
    """
    held: list[list[tuple]] = [[], [], []]  # heaps of (-hash, text, spans)
    known: list[set[int]] = [set(), set(), set()]

    def offer(label: int, text: str, spans: list[Span]) -> None:
        digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        key = int.from_bytes(digest) >> 1
        if key in known[label] or len(held[label]) == sample and -held[label][0][0] < key:
            return
        known[label].add(key)
        heapq.heappush(held[label], (-key, text, [n for s in spans for n in s]))
        if len(held[label]) > sample:
            known[label].discard(-heapq.heappop(held[label])[0])

    def largest() -> bytes:
        """The digest above which no text of the third class is kept."""
        key = -held[2][0][0] if len(held[2]) == sample else (1 << 63) - 1
        return (key << 1 | 1).to_bytes(8)

    limit = largest()
    for batch in batches:
        for _, _, texts in text_steps(batch.column(0)):
            for text in texts:
                spans = sorted(base_spans(text))
                firsts = [s[0] for s in spans]
                for a, b, _, _ in windows(text):
                    own = spans[max(0, int(np.searchsorted(firsts, a)) - 1) :]
                    inner, whole = [], True
                    for start, end, kind in own:
                        if start >= b:
                            break
                        if end > a:
                            last = inner[-1][1] if inner else 0
                            whole &= start >= a and end <= b and start - a >= last
                            inner.append((start - a, end - a, kind))
                    if whole:
                        offer(int(bool(inner)), text[a:b], inner)
                starts = plain(text).tolist()
                if not text.isascii():
                    for a in starts:
                        offer(2, text[a : a + WIDTH], [])
                    continue
                data = text.encode("ascii")
                for a in starts:
                    part = data[a : a + WIDTH]
                    if blake2b(part, digest_size=8).digest() <= limit:
                        offer(2, part.decode("ascii"), [])
                        limit = largest()
    for label in range(3):
        if rows := held[label]:
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([label] * len(rows), pa.int32()),
                "hash": pa.array([-r[0] for r in rows], pa.int64()),
                "text": pa.array([r[1] for r in rows], pa.string()),
                "spans": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            })


def _rewritten(span: str, kind: int, rng: np.random.Generator) -> str:
    """A span of the same kind, with other digits and in another notation."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    span = _DIGIT.sub(lambda m: str(rng.integers(10)), span)
    if kind == 0:
        at, dot = pick("@", " @ ", " (at) ", "(at)", "[at]", " at "), pick(".", ".", " dot ", "[.]")
        name, _, domain = span.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == 1:
        parts = [str(rng.integers(256)) for _ in range(4)]
        return pick(".", "[.]", " . ", ",").join(parts)
    digits = _digits(span)
    if kind == 2:
        gap = pick("", " ", "-", ".", "/", "_")
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    gap, size = pick(" ", "-", ".", "/", ""), pick(2, 3, 4)
    first = pick("", "", "+", "00", "0", "(0)")
    return first + gap.join(digits[i : i + size] for i in range(0, len(digits), size))


def _harmless(rng: np.random.Generator) -> str:
    """A number that is no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    choices = [
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}",
        f"{n(1, 999)},{n(0, 1000):03}.{n(0, 100):02}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}",
        f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", str(n(0, 10 ** n(1, 9))), f"{n(1, 100)}%",
        bytes(rng.integers(0, 256, n(4, 21), dtype=np.uint8)).hex(), f"#{n(1, 100000)}",
        f"@{n(1, 100)}", f"v{n(0, 9)}.{n(0, 30)}", f"{n(1, 500)}-{n(500, 999)}",
    ]
    return choices[n(0, len(choices))]


def examples(
    held: list[tuple[str, list[Span]]], seed: int = 12, copies: int = 2
) -> list[tuple[str, list[Span]]]:
    """Labelled windows as they are, and ``copies`` of each with its spans rewritten."""
    rng = np.random.default_rng(seed)
    out = []
    for text, spans in held:
        out.append((text, spans))
        for _ in range(copies):
            made, labels, at = "", [], 0
            for start, end, kind in sorted(spans):
                made += text[at:start]
                new = _rewritten(text[start:end], kind, rng)
                labels.append((len(made), len(made) + len(new), kind))
                made, at = made + new, end
            made += text[at:]
            blanks = [m.start() for m in re.finditer(" ", made)
                      if not any(a <= m.start() < b for a, b, _ in labels)]
            if blanks:
                place = blanks[int(rng.integers(len(blanks)))]
                plain = " " + _harmless(rng)
                made = made[:place] + plain + made[place:]
                labels = [
                    (a + len(plain) * (a > place), b + len(plain) * (a > place), k)
                    for a, b, k in labels
                ]
            out.append((made, labels))
    return out


def train(
    df: DataFrame, text_col: str = "text", where: Column | None = None, sample: int = SAMPLE
) -> Model:
    """Learn from at most ``sample`` windows with base spans and as many of each other class."""
    rows = (df if where is None else df.where(where)).select(F.col(text_col).alias("text"))
    near = rows.where("text is not null").mapInArrow(lambda b: _examples(b, sample), _ROWS)
    near = materialize(near.dropDuplicates(["label", "hash"]), "pii-examples")
    held = [
        (r.text, list(zip(r.spans[::3], r.spans[1::3], r.spans[2::3], strict=True)))
        for label in (1, 0)
        for r in near.where(F.col("label") == label).orderBy("hash").limit(sample).collect()
    ]
    far = near.where("label = 2").orderBy("hash").limit(sample).collect()
    if not any(spans for _, spans in held):
        return Model(None)
    return Model(tagger.fit(examples(held) + [(r.text, []) for r in far], len(BASE)))


def scan(df: DataFrame, model: Model, text_col: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns of each row with its text and ``spans``: (start, kind, end) in order."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*(keep or []), F.col(text_col).alias("text"))

    def run(texts):
        found = shared.value.scan([t or "" for t in texts])
        return {"spans": pa.array(
            [[{"start": a, "kind": k, "end": b} for a, b, k in spans] for spans in found],
            pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])),
        )}

    return judged(rows, "text", run, f"spans array<{_SPAN}>", CHARS)


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def report(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans written out, and added spans."""
    found = scan(df, model, text_col, [F.col(id_col).alias("doc_id")])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
