import hashlib
import random

import public_tokenizers
import pytest

from personae.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def samples():
    rng = random.Random(5)
    parts = [
        *"aabcdeEST 's're\n\t.!?19²½ÉéßΣσςİıñ日本́̈😀\x1c\x85 　ＡK", SPECIAL, "<|startoftext|>",
        "'ll", "Σ ", "ǅ", "the ", "and ", "tion", "<|",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(2000)]
    return [*texts, "", "   ", "a" * 5000, "ab " * 3000, SPECIAL * 3, f"x{SPECIAL}y"]


def test_equals_the_library(library):
    texts, codec = samples(), bpe.Codec(PATH)
    assert codec.encode(texts) == expected(library, texts)


def test_decode_equals_the_library(library):
    codec = bpe.Codec(PATH)
    for ids in expected(library, samples()):
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_small_memory_changes_nothing(library, monkeypatch):
    texts, codec = samples(), bpe.Codec(PATH)
    codec.memory._limit = 50
    monkeypatch.setattr(bpe, "WORDS", 20)
    assert [i for t in texts for i in codec.encode([t])] == expected(library, texts)


def test_words_that_come_again_are_merged_once(library, monkeypatch):
    codec, merged = bpe.Codec(PATH), []
    monkeypatch.setattr(bpe, "WORDS", 20)
    monkeypatch.setattr(
        codec.vocabulary, "merge",
        lambda words, merge=codec.vocabulary.merge: merged.extend(words) or merge(words),
    )
    codec.memory._limit = 1
    texts = [f"again and{'xyz'[i % 3]} {'abcdefghij'[i // 10] * 3}{'abcdefghij'[i % 10]}" for i in range(100)]
    assert [codec.encode([t])[0] for t in texts] == expected(library, texts)
    assert merged.count("again") == 1 and len(codec._words) + len(codec._older) <= 24


def test_rows(spark, library):
    texts = [None, "", "The  thing's <|endoftext|>", "The  thing's <|endoftext|>", "word " * 20000]
    df = spark.createDataFrame(
        [(i if i != 1 else None, t, "x") for i, t in enumerate(texts)],
        "doc_id long, text string, n_tokens string",
    )
    rows = bpe.digests(df, PATH).collect()
    want = []
    for i, (t, ids) in enumerate(zip(texts, expected(library, texts), strict=True)):
        text = library.decode(ids, skip_special_tokens=False)
        shas = [
            hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)
        ]
        want.append((i if i != 1 else None, len(ids), *shas))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    ids = bpe.encode(df, PATH, keep=["doc_id"])
    back = {r.doc_id: r.decoded for r in bpe.decode(ids, PATH, keep=["doc_id"]).collect()}
    assert back[2] == library.decode(expected(library, texts)[2], skip_special_tokens=False)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "bad.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="no earlier merge"):
        bpe.Vocabulary(str(tmp_path / "bad.json"))
