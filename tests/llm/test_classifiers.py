import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from personae.llm import langid, quality
from personae.llm.batches import remainder

SF = "/root/testdata/sf0.01"
ODD = [
    (1, None, None, "x"), (2, "", "en", "x"), (3, " 12 !\n", "en", "x"), (None, "the", "en", "x"),
    (5, "the " * 400_000, "en", "x"), (6, "der und", "de", "x"), (6, "der und", "de", "x"),
]
SCHEMA = "doc_id long, text string, lang string, score string"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, where=remainder("doc_id", 4) != 2)
    rows = langid.identify(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_equals_plain_naive_bayes(spark):
    docs = [("en", "the cat and the dog"), ("de", "der Hund und die Katze"), ("de", "Öl, Öl")]
    df = spark.createDataFrame(docs, "lang string, text string")
    model = langid.train(df, buckets=1 << 14)

    def grams(text):
        chars = ["".join(c.lower() for c in w if c.isalpha()) for w in text.split()]
        s = " ".join(chars) + (" " if text[-1:].strip() and not text[-1].isalpha() else "")
        return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n].strip()]

    counts = {}
    for lang, text in docs:
        for g in grams(text):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    text = "das Katzendoggen"
    logp = []
    for lang in ("de", "en"):
        total = sum(counts[lang].values()) + 0.5 * (1 << 14)
        prior = np.log(sum(x == lang for x, _ in docs) / len(docs))
        logp.append(
            prior + sum(np.log((counts[lang].get(g, 0) + 0.5) / total) for g in grams(text))
        )
    want = 1 / np.exp(np.array(logp) - max(logp)).sum()
    found, sure, _ = model.score([text])
    assert found == ["de"] and sure[0] == pytest.approx(want, abs=1e-4)


def test_language_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    model = langid.train(df)
    rows = langid.identify(df, model).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "en", "de", "de"]
    assert [r.score for r in rows[:3]] == [0, 0, 0]
    nothing = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_language_of_a_text_longer_than_a_step(monkeypatch):
    model = langid.Model(["a", "b"], np.zeros(2), np.random.default_rng(1).normal(size=(64, 2)))
    text = "abc déf ghi " * 50
    monkeypatch.setattr(langid, "CHARS_PER_STEP", 100)
    assert model.score([text])[0] == model.score([text, "x"])[0][:1]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, where=remainder("doc_id", 5) != 0)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert len(got) == docs.count()
    held = [
        (r["quality"], got[r["doc_id"]])
        for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    ]
    assert np.mean([y == r.predicted for y, r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame(
        [(2, 1), (3, 0), (5, 1), (6, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int"
    )
    model = quality.train(df, labels)
    rows = quality.classify(df, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score and rows[5].score == rows[6].score
    one_class = quality.train(df, labels.where("quality = 1"))
    assert {r.score for r in quality.classify(df, one_class).collect()} == {1.0}
    nothing = quality.train(df, labels.limit(0))
    assert {r.score for r in quality.classify(df, nothing).collect()} == {0.5}
    assert quality.classify(df.limit(0), model).count() == 0


def test_attention_finds_the_passage_that_decides():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    clean = lambda n: " ".join(rng.choices(words, k=n))
    junk = lambda n: " ".join(w.upper() + "!!" for w in rng.choices(words, k=n))
    texts = [clean(500) if i % 2 else f"{clean(300)} {junk(100)} {clean(200)}" for i in range(120)]
    bags = [quality.passages(t) for t in texts]
    x = quality.features([p for b in bags for p in b])
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    model = quality.fit(x, bag, np.arange(120) % 2.0)
    score = model.score([clean(600), f"{clean(100)} {junk(90)} {clean(400)}"])
    assert score[0] > 0.8 and score[1] < 0.2
    h, a = quality._attend(model.weights, quality.features([clean(70), junk(70)]))
    assert a[1] > a[0]


def test_gradients():
    """One small step of training lowers the loss; scores equal the formula."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, quality.N_FEATURES)).astype(np.float32)
    bag, y = np.repeat(np.arange(10), 4), np.arange(10) % 2.0
    loss = []
    for epochs in (1, 20, 200):
        w = quality.fit(x, bag, y, epochs=epochs).weights
        h, a = quality._attend(w, x)
        z = np.add.reduceat(a[:, None] * h, np.arange(0, 40, 4)) / np.add.reduceat(
            a, np.arange(0, 40, 4)
        )[:, None]
        p = quality._sigmoid(z @ w["c"] + w["c0"])
        loss.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert loss[0] > loss[1] > loss[2] and loss[2] < 0.1
