import itertools
import pickle
import re
import time
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pytest

from personae.llm import pii, reader, tagger
from personae.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in enumerate(PLAIN.values()):
        for m in re.finditer(pattern, text):
            hit = m.group()
            digits = re.sub("[^0-9]", "", hit)
            if kind == 1 and any(int(p) > 255 for p in hit.split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return out


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(4)
    pieces = list("ab.@%+-_ ()19é\n") + [
        "4111111111111111", "4111-1111-1111-1111", "+1 (528) 555-3435", "10.0.0.255", "0010.2.3.4",
        "a.b@c.de", "x@y", "@@", "256.1.1.1", "1.2.3.4.5.6.7.8", "+49 30 1234567", "..", "--",
    ]
    for _ in range(3_000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", [
    "1" * 200_000, "a" * 200_000 + "@", "1.1." * 50_000, "+1" * 50_000, "a@" * 100_000,
    "1 " * 100_000, "+1" + " " * 200_000, "x@" + "a." * 100_000,
])
def test_long_texts_take_linear_time(text):
    pii.base_spans(text)
    assert sum(1 for _ in pii.windows(text)) <= len(text) / (pii.WIDTH / 2) + 2


def test_windows_cover_what_is_near_a_digit():
    text = "x" * 100 + "1" * 300 + "y" * 100 + "@" + "z" * 500
    covered = np.zeros(len(text), bool)
    for a, b, _, _ in pii.windows(text):
        covered[a:b] = True
        assert b - a <= pii.WIDTH
    near = np.zeros(len(text), bool)
    for i, c in enumerate(text):
        if c in "1@":
            near[max(0, i - pii.REACH) : i + 1 + pii.REACH] = True
    assert (covered >= near).all() and not covered[-300:].any()


class OneAddress:
    """In place of a tagger: finds one address that has no digit and no "@"."""

    address = "jo (at) we dot org"

    def decode(self, x, inside):
        path = np.zeros(x.shape, np.int8)
        for row, codes, on in zip(path, x, inside, strict=True):
            at = bytes(codes[on].astype(np.uint8)).find(self.address.encode())
            if at >= 0:
                row[at : at + len(self.address)] = 1
        return path, path[:, :, None]

    def spans(self, path, above):
        marked = np.flatnonzero(path)
        return [(int(marked[0]), int(marked[-1]) + 1, 0, 9.0)]


def test_text_without_digits_and_signs_is_read_as_well():
    texts, want = [], []
    for before in [0, 1, 500, *range(900, 1030, 3), 5_000]:
        texts.append("w" * before + " " + OneAddress.address + " word" * 500)
        want.append([(before + 1, before + 1 + len(OneAddress.address), 4)])
    assert pii.Model(OneAddress()).scan(texts) == want


def test_passages_cover_every_character():
    for size in (0, 1, pii.PASSAGE - 1, pii.PASSAGE, pii.PASSAGE + 1, 10_000):
        seen, last = np.zeros(size, int), 0
        for a, b, first_cut, last_cut in pii.passages("z" * size):
            assert 0 < b - a <= pii.PASSAGE and first_cut == (a > 0) and last_cut == (b < size)
            assert a == 0 or last - a == pii.OVERLAP
            seen[a:b] += 1
            last = b
        assert (seen >= 1).all() and last == size


def test_fast_reading_gives_the_same_states_and_tags():
    rng = np.random.default_rng(7)
    quiet = 0
    for trial in range(40):
        net = tagger.Tagger.fresh(3, 5, rng)
        net.w["T"] = rng.normal(0, 1, net.w["T"].shape).astype(np.float32)
        net.w["o"][1:] -= rng.uniform(0, 6)
        texts = ["".join(rng.choice(list("a1 .@"), rng.integers(1, 30))) for _ in range(8)]
        x, inside = tagger.filled([tagger.codes(t) for t in texts])
        for side in "fb":
            states, _ = net._states(side, x, inside)
            assert np.allclose(net._read(side, x, inside).transpose(2, 0, 1), states, atol=1e-5)
        emission = net.scores(x, inside)
        path, above = net.decode(x, inside)
        assert (path == net._best(emission, inside)).all()
        quiet += net._quiet(above, inside).sum()
    assert 20 < quiet < 300


def test_reading_takes_less_time_than_the_activations_of_numpy():
    """Each place has 96 gates and 24 cells in either direction; numpy's tanh of those alone is slower."""
    rng = np.random.default_rng(3)
    net = pickle.loads(pickle.dumps(tagger.Tagger.fresh(4, 24, rng)))
    x = rng.integers(0, tagger.CODES, (256, 300))
    inside = np.arange(300) < rng.integers(200, 301, 256)[:, None]
    gates = rng.normal(0, 1, (120, 256)).astype(np.float32)
    for side in "fb":  # long windows, too, have the states of the plain formulas
        states, _ = net._states(side, x, inside)
        assert np.allclose(net._read(side, x, inside).transpose(2, 0, 1), states, atol=1e-4)

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    reading = min(seconds(lambda: net._read("f", x, inside)) for _ in range(5))
    tanh = min(seconds(lambda: [np.tanh(gates) for _ in range(300)]) for _ in range(5))
    assert reading < tanh


def test_windows_share_lanes_without_filling(monkeypatch):
    rng = np.random.default_rng(11)
    net = tagger.Tagger.fresh(3, 5, rng)
    net.w["o"] = rng.normal(0, 1, 7).astype(np.float32)
    texts = ["".join(rng.choice(list("a1 .@"), n)) for n in rng.integers(1, 200, 3_000)]
    x, inside = tagger.filled([tagger.codes(t) for t in texts])
    read, run = [], reader._run

    def spied(codes, *args):
        read.append(codes.size)
        return run(codes, *args)

    monkeypatch.setattr(reader, "_run", spied)
    above = net.above(x, inside)
    assert len(read) == 2 and max(read) < 1.1 * inside.sum() < 0.6 * x.size
    monkeypatch.undo()
    want = net.scores(x, inside)
    want = want - want[:, :, :1]
    for k, n in enumerate(inside.sum(axis=1)):
        assert np.allclose(above[k][:n], want[k, :n], atol=1e-4)


def test_lanes_of_passages_are_full():
    rng = np.random.default_rng(13)
    for _ in range(20):
        texts = rng.lognormal(7.6, 1, 230).astype(int) + 1
        lengths = np.array([b - a for n in texts for a, b, _, _ in pii.passages("z" * n)])
        lane, start, places = reader.lanes(lengths)
        assert (lane.max() + 1) * places < 1.04 * lengths.sum()
        order = np.lexsort((start, lane))
        same = np.diff(lane[order]) == 0
        gaps = start[order][1:] - (start + lengths)[order][:-1]
        assert (gaps[same] >= 1).all() and start.min() == 1 and (start + lengths).max() < places


def test_digits_are_looked_for_without_losing_spans():
    rng = np.random.default_rng(14)
    pieces = list("ab.@%+-_ ()19é\n漢\ud800²٣") + [
        "4111111111111111", "4111-1111-1111-1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "10.0.0.255",
        "0010.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "1.2..3.4", "+49 30 1234567", "--", "word " * 9,
    ]
    found = [0, 0]
    for _ in range(1_500):
        text = "".join(rng.choice(pieces, rng.integers(1, 12)))
        text = text.center(pii.SHORT + len(text), str(rng.choice(list("z é."))))
        assert pii.base_spans(text) == plain_spans(text), text
        found = [n + h for n, h in zip(found, pii._holds(text), strict=True)]
        starts = [a for a, b, _, _ in pii.passages(text, pii.WIDTH) if not re.search("[0-9@]", text[a:b])]
        assert pii.plain(text).tolist() == starts
        want = [
            48 if c in "0123456789" else ord(c) if c < "\x80" else 128 if c.isalpha() else 129 for c in text
        ]
        assert tagger.codes(text).tolist() == want
    assert 100 < min(found) and max(found) < 1_200
    assert pii.plain("").tolist() == [] and tagger.codes("").tolist() == []


def test_examples_of_plain_text_have_the_smallest_hashes():
    rng = np.random.default_rng(15)
    texts = ["".join(rng.choice(list("abc é" if i % 3 else "abc 1"), rng.integers(1, 900))) for i in range(60)]
    parts = {
        t[a:b] for t in texts for a, b, _, _ in pii.passages(t, pii.WIDTH) if not re.search("[0-9@]", t[a:b])
    }
    keys = {
        int.from_bytes(blake2b(p.encode(), digest_size=8).digest()) >> 1: p for p in parts
    }
    batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 7]}) for i in range(0, 60, 7)]
    rows = [r for b in pii._examples(iter(batches), 50) for r in b.to_pylist() if r["label"] == 2]
    assert {r["hash"]: r["text"] for r in rows} == {k: keys[k] for k in sorted(keys)[:50]}
    assert len(rows) == 50 < len(keys)


def test_best_tags_of_windows_of_any_lengths():
    rng = np.random.default_rng(16)
    net = tagger.Tagger.fresh(2, 4, rng)
    net.w["T"] = rng.normal(0, 1, net.w["T"].shape).astype(np.float32)
    move = net.w["T"] + net.fixed
    lengths = np.array([3, 40, 1, 17, 40, 2, 25])
    inside = np.arange(40) < lengths[:, None]
    emission = rng.normal(0, 1, (7, 40, 5)).astype(np.float32)
    path = net._best(emission, inside)
    for row, n in enumerate(lengths):
        score, back = emission[row, 0] + move[-1], []
        for t in range(1, n):
            step = score[:, None] + move[:-1]
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + emission[row, t]
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        assert path[row].tolist() == tags[::-1] + [0] * (40 - n)


def test_reconciled_joins_halves_and_keeps_the_best():
    found = [
        (10, 20, 3, 5.0, True), (15, 30, 3, 6.0, True),  # two halves
        (40, 50, 1, 9.0, False), (40, 50, 1, 8.0, False),  # one span from two windows
        (60, 80, 0, 7.0, False), (78, 90, 2, 9.0, False), (88, 99, 0, 7.0, False),
        (120, 130, 0, 1.0, False),  # below the margin
    ]
    assert pii.reconciled(found) == [(10, 30, 3), (40, 50, 1), (60, 80, 0), (88, 99, 0)]


def test_gradients():
    rng = np.random.default_rng(0)
    net = tagger.Tagger.fresh(2, 4, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, inside = tagger.filled([tagger.codes(t) for t in ("call +1 2", "é", "a@b.c 12 x")])
    y = np.where(inside, 1, 0)
    y[0, 5:9] = 3, 4, 4, 4
    _, grads = net.loss(x, inside, y)
    for name, w in net.w.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        w[at] += 1e-4
        up = net.loss(x, inside, y)[0]
        w[at] -= 2e-4
        down = net.loss(x, inside, y)[0]
        w[at] += 1e-4
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-3)  # states in float32


def test_decoding_equals_trying_all_paths():
    rng = np.random.default_rng(1)
    net = tagger.Tagger.fresh(2, 4, rng)
    net.w["T"] = rng.normal(0, 1, net.w["T"].shape).astype(np.float32)
    x, inside = tagger.filled([tagger.codes(t) for t in ("a1@b", "+12")])
    path, above = net.decode(x, inside)
    scores, move = net.scores(x, inside), net.w["T"] + net.fixed
    for row, n in enumerate((4, 3)):
        def value(p, row=row):
            return sum(scores[row, t, g] + move[p[t - 1] if t else -1, g] for t, g in enumerate(p))

        best = max(itertools.product(range(5), repeat=n), key=value)
        assert tuple(path[row, :n]) == best and not path[row, n:].any()
        spans = net.spans(path[row, :n], above[row])
        for start, end, _, margin in spans:
            without = [0 if start <= t < end else g for t, g in enumerate(best)]
            if end == n or best[end] % 2 or best[end] == 0:
                assert margin == pytest.approx(value(best) - value(without), abs=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), where="doc_id % 2 = 1")


def test_finds_notations_that_the_patterns_miss(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    held = []
    for batch in pii._examples(iter(docs.select("text").toArrow().to_batches()), 300):
        for row in batch.to_pylist():
            s = row["spans"]
            held.append((row["text"], list(zip(s[::3], s[1::3], s[2::3], strict=True))))
    made = pii.examples([h for h in held if h[1]], seed=99)
    found = model.added([text for text, _ in made])
    hit = sum(len(set(f) & set(w)) for f, (_, w) in zip(found, made, strict=True))
    total, added = sum(len(w) for _, w in made), sum(map(len, found))
    assert hit / total > 0.6 and hit / added > 0.9


def test_leaves_harmless_numbers_and_clean_documents_alone(spark, model):
    rng = np.random.default_rng(5)
    plain = [f"the {pii._harmless(rng)} quick fox and {pii._harmless(rng)} end" for _ in range(1000)]
    assert sum(any(k >= 4 for *_, k in s) for s in model.scan(plain)) <= 5
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    texts = [r.text or "" for r in docs.select("text").collect()]
    clean = [t for t in texts if not pii.base_spans(t)]
    assert sum(bool(s) for s in model.scan(clean)) <= len(clean) / 1000


def test_scan_of_odd_rows(spark, model):
    rows = [
        (1, None, "k"), (1, "", "k"), (None, "mail a.b@c.de now", "k"), (None, "mail a.b@c.de now", "k"),
        (2, "é" * 40 + " +1 (528) 555-3435 " + "z" * 200_000 + " 10.0.0.7", "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.scan(df, model, keep=["doc_id", "kind"]).collect()
    assert [r.kind for r in got] == ["k"] * 5 and [r.text for r in got] == [r[1] for r in rows]
    flat = [[(s.start, s.end, s.kind) for s in r.spans] for r in got]
    assert flat[:4] == [[], [], [(5, 13, 0)], [(5, 13, 0)]]
    assert flat[4] == [(41, 58, 3), (200_060, 200_068, 1)]
    assert pii.report(df.limit(0), model).count() == 0
    assert [r.n_email for r in pii.report(df, model).collect()] == [0, 0, 1, 1, 0]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "no data 12"), (2, None)], "doc_id long, text string")
    model = pii.train(df)
    assert model.net is None and model.scan(["+1 (528) 555-3435"]) == [[(0, 17, 3)]]
    assert pii.train(df.limit(0)).net is None


def test_query_has_all_base_spans(spark):
    got = {r.doc_id: r for r in QUERIES["op12_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = sorted(plain_spans(d.text or ""), key=lambda s: (s[0], s[2]))
        r = got[d.doc_id]
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == i for *_, k in want) for i in range(4)
        ]
        assert [s for s in r.spans.split(",") if s and not s.startswith("model_")] == named
