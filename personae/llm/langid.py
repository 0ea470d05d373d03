"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are no letters becomes one blank. All
n-grams of one to three characters that hold a letter are hashed into ``buckets``. Training
counts them over every labelled row: each task adds up a vector per language, Spark sums the
vectors, and the matrix of smoothed log-probabilities (languages x buckets, the only thing
that reaches the driver) is broadcast. Scoring looks up each n-gram's row of the matrix and
sums per text.

``fit`` tells whether a text is in that language at all, which the posterior cannot: the mean
log-probability of its n-grams, less that of the training rows' n-grams of the language, plus
``SLACK`` / sqrt(n-grams) for texts too short to tell. Other letters or scripts are 4 and more below.

Defined cases: null, empty or letterless text gives ``und``, score 0 and no fit, as does everything
if no training row has a language and a letter. Equal scores go to the language that sorts
first. Texts of any length are worked through in steps of fixed size. Rows with repeated or
null ids are scored one by one, other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.llm.batches import CHARS_PER_STEP, judged, steps

UNDETERMINED = "und"
BUCKETS = 1 << 14
SMOOTHING = 0.5
SLACK = 6.0

_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for anything that is no letter."""
    if not _tables:
        lower = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                small = c.lower()
                lower[i] = ord(small) if len(small) == 1 else i
        _tables.append(lower)
    return _tables[0]


def _grams(text: str, buckets: int) -> list[np.ndarray]:
    """Bucket numbers of the 1-, 2- and 3-grams of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _lower_letters()[points]
    letter = c > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter stays
    c = c[keep].astype(np.uint64)
    if not len(c):
        return []
    a = c * np.uint64(0x9E3779B97F4A7C15)
    out = [_bucket(a[c > 0], buckets)]
    for _ in range(2):
        if len(a) < 2:
            break
        c = c[1:]
        a = a[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (c + np.uint64(1)) * np.uint64(
            0x165667B19E3779F9
        )
        out.append(_bucket(a, buckets))
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _slices(text: str) -> list[str]:
    return [text[i : i + CHARS_PER_STEP] for i in range(0, len(text), CHARS_PER_STEP)]


class Model:
    """Languages in order, log priors, and log-probabilities by bucket and language.

    ``typical``: the mean log-probability of each language's own n-grams.
    """

    def __init__(
        self, langs: list[str], prior: np.ndarray, table: np.ndarray,
        typical: np.ndarray | None = None,
    ):
        self.langs, self.prior, self.table = langs, prior, table
        self.typical = np.zeros(len(langs)) if typical is None else typical

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[float | None]]:
        """Language, its posterior probability and the fit of each text."""
        found, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        fit: list[float | None] = [None] * len(texts)
        if not self.langs:
            return found, sure, fit
        buckets = len(self.table)
        for i, j in steps(texts):
            grams, owner, at = [], [], 0
            for row in range(i, j):
                own = [g for part in _slices(texts[row] or "") for g in _grams(part, buckets)]
                if own:
                    owner.append((row, at))
                    grams += own
                    at += sum(map(len, own))
            if not owner:
                continue
            starts = [s for _, s in owner]
            own = np.add.reduceat(
                self.table[np.concatenate(grams)], starts, axis=0, dtype=np.float64
            )
            number = np.diff(starts, append=at)
            logp = own + self.prior
            best = logp.argmax(axis=1)
            total = np.exp(logp - logp.max(axis=1, keepdims=True)).sum(axis=1)
            mean = own[np.arange(len(best)), best] / number - self.typical[best]
            near = mean + SLACK / np.sqrt(number)
            for (row, _), k, t, f in zip(owner, best, total, near.tolist(), strict=True):
                found[row], sure[row], fit[row] = self.langs[k], 1.0 / t, f
        return found, sure, fit


def train(
    df: DataFrame, text_col: str = "text", label_col: str = "lang",
    where: Column | None = None, buckets: int = BUCKETS, smoothing: float = SMOOTHING,
) -> Model:
    """Fit on every row of ``df`` that satisfies ``where`` and has text and label."""
    rows = df if where is None else df.where(where)
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang")).where(
        "text is not null and lang is not null"
    )

    def count(batches):
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(buckets + 1, np.int64))
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)

        def add():
            for lang, grams in waiting.items():
                sums[lang][:buckets] += np.bincount(np.concatenate(grams), minlength=buckets)
            waiting.clear()

        def flush():
            add()
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(at), "bucket": at, "n": n[at]}
                )
            sums.clear()

        for batch in batches:
            size = 0
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in _slices(text):
                    if grams := _grams(part, buckets):
                        waiting[lang] += grams
                        size += len(part)
                    if size > CHARS_PER_STEP:
                        add()
                        size = 0
                if lang in sums or lang in waiting:
                    sums[lang][buckets] += 1
            if len(sums) > 100:
                yield from flush()
        yield from flush()

    counts = (
        rows.mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(counts["lang"].to_pylist()))
    place = {lang: k for k, lang in enumerate(langs)}
    n = np.zeros((buckets + 1, len(langs)))
    where_lang = np.array([place[x] for x in counts["lang"].to_pylist()], int)
    n[counts["bucket"].to_numpy(), where_lang] = counts["n"].to_numpy()
    texts, grams = n[buckets], n[:buckets] + smoothing
    prior = np.log(texts / max(texts.sum(), 1.0)) if langs else texts
    table = np.log(grams / grams.sum(axis=0))
    typical = (n[:buckets] * table).sum(axis=0) / np.maximum(n[:buckets].sum(axis=0), 1.0)
    return Model(langs, prior, table.astype(np.float32), typical)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``fit``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        found, sure, fit = shared.value.score(texts)
        return {"lang_pred": found, "score": sure, "fit": pa.array(fit, pa.float64())}

    return judged(df, text_col, run, "lang_pred string, score double, fit double")
