"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` characters, none left out. Each passage is
described by its surface: frequencies of pairs of adjacent character classes, and how far it
can be compressed. A tanh layer encodes it as h, gated attention weighs it,

    a = exp(w . (tanh(V h) * sigmoid(U h))),    z = sum(a h) / sum(a),

and a logistic unit scores the weighted document vector z. Encoder, attention and output are
learned together from document labels. No word, label, language, source or id is an input.

Training takes a bounded sample: the ``SAMPLE`` labelled documents with the smallest id hash,
among texts of at most ``SAMPLE_CHARS`` characters. Scoring covers all passages of all texts;
since attention logits are bounded, sums are kept step by step and a text of any length needs
little memory.

Defined cases: null and empty texts are one passage without features. Labels of a repeated
doc_id count as one, the largest. Without a label of each class, every score is the share of
label 1 (0.5 if there is no label at all). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.llm.batches import CHARS_PER_STEP, judged, map_rows, steps

PASSAGE = 512
SAMPLE = 6_000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.3

_MARKS = [" ", "\n\t\r", ".", ",", "!", "?", "\"'`()[]{}", "|", "#$%&*~^=+<>_\\/@", "-:;"]
_CLASSES = 3 + len(_MARKS) + 1
N_FEATURES = _CLASSES * _CLASSES + 2


@cache
def _classes() -> np.ndarray:
    """Character class of each code point: letters by case, digits, marks, the rest."""
    table = np.full(0x110000, _CLASSES - 1, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            table[i] = 2
    for k, marks in enumerate(_MARKS):
        for c in marks:
            table[ord(c)] = 3 + k
    return table


def passages(text: str | None) -> list[str]:
    text = text or ""
    return [text[i : i + PASSAGE] for i in range(0, len(text), PASSAGE)] or [""]


def features(parts: list[str]) -> np.ndarray:
    """One row for each passage, in float32."""
    out = np.zeros((len(parts), N_FEATURES), np.float32)
    lengths = np.array([len(p) for p in parts])
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points].astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), lengths)
    pair = kind[:-1] * _CLASSES + kind[1:]
    inside = owner[:-1] == owner[1:]
    size = _CLASSES * _CLASSES
    counts = np.bincount(
        owner[:-1][inside] * size + pair[inside], minlength=len(parts) * size
    ).reshape(len(parts), size)
    out[:, :size] = np.sqrt(counts / np.maximum(lengths - 1, 1)[:, None])
    for i, part in enumerate(parts):
        raw = part.encode("utf-8", "surrogatepass")
        out[i, size] = len(zlib.compress(raw, 1)) / (len(raw) + 16)
    out[:, size + 1] = lengths / PASSAGE
    return out


class Model:
    """Weights of the network; ``constant`` is set if there was nothing to learn."""

    def __init__(self, weights: dict[str, np.ndarray] | None, constant: float = 0.5):
        self.weights, self.constant = weights, constant

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        w = self.weights
        out = np.zeros(len(texts))
        for i, j in steps(texts):
            top, low = np.zeros((j - i, len(w["c"]))), np.zeros(j - i)
            bags = [passages(t) for t in texts[i:j]]
            flat = [(k, p) for k, bag in enumerate(bags) for p in bag]
            size = max(1, CHARS_PER_STEP // PASSAGE)
            for s in range(0, len(flat), size):
                owner = np.array([k for k, _ in flat[s : s + size]])
                h, a = _attend(w, features([p for _, p in flat[s : s + size]]))
                np.add.at(top, owner, a[:, None] * h)
                np.add.at(low, owner, a)
            out[i:j] = _sigmoid((top / low[:, None]) @ w["c"] + w["c0"])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _attend(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["E"] + w["e0"])
    return h, np.exp((np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"])


def fit(
    x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12,
    epochs: int = 300, rate: float = 0.01, decay: float = 1e-4, seed: int = 7,
) -> Model:
    """Adam on the log loss of document scores. ``bag``: document number of each passage."""
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    xs = ((x - mean) / scale).astype(np.float64)
    w = {
        "E": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "e0": np.zeros(hidden),
        "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, 0.1, gate),
        "c": rng.normal(0, hidden**-0.5, hidden), "c0": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    docs = len(y)
    starts = np.searchsorted(bag, np.arange(docs))

    def per_doc(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, starts, axis=0)

    for step in range(1, epochs + 1):
        h = np.tanh(xs @ w["E"] + w["e0"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        a = np.exp((t * s) @ w["w"])
        share = a / per_doc(a)[bag]
        z = per_doc(share[:, None] * h)
        p = _sigmoid(z @ w["c"] + w["c0"])
        # gradients, from the output back to the encoder
        d = (p - y) / docs
        dz = d[:, None] * w["c"]
        dlogit = share * ((h - z[bag]) * dz[bag]).sum(axis=1)
        dt = dlogit[:, None] * w["w"] * s * (1 - t * t)
        ds = dlogit[:, None] * w["w"] * t * s * (1 - s)
        dh = (share[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        grads = {
            "E": xs.T @ dh, "e0": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds,
            "w": (t * s).T @ dlogit, "c": z.T @ d, "c0": np.array([d.sum()]),
        }
        for k, g in grads.items():
            g = g + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] -= rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return Model(w | {"mean": mean, "scale": scale})


def train(
    docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Fit on at most ``sample`` labelled documents; ``where`` selects label rows by id."""
    known = labels if where is None else labels.where(where)
    known = (
        known.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .dropna().groupBy("id").agg(F.max("y").cast("double").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounds the broadcast
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(chosen), "id").select("id", "text", "y")
    )

    def describe(batch):
        for i, j in steps(texts := batch.column(1).to_pylist()):
            bags = [passages(t) for t in texts[i:j]]
            x = features([p for bag in bags for p in bag])
            ends = np.cumsum([len(bag) for bag in bags])
            yield {
                "id": batch.column(0)[i:j], "y": batch.column(2)[i:j],
                "x": [part.tobytes() for part in np.split(x, ends[:-1])],
            }

    got = map_rows(rows, describe, "id long, y double, x binary").dropDuplicates(["id"])
    got = got.toArrow().sort_by("id")
    bags = [
        np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"].to_pylist()
    ]
    if not bags:
        return Model(None)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return fit(np.concatenate(bags), bag, got["y"].to_numpy())


def classify(
    docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        score = shared.value.score(texts)
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return judged(docs, text_col, run, "score double, predicted int")
