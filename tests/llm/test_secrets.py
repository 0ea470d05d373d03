import hashlib
import math
import random
import time
import re

import pytest
from pyspark.sql import functions as F

from personae.llm import secret_scan as S

BASE = [
    ("assign", re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    ), lambda m: len(m.group(2)) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
]
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def phi(z):
    return 1 / (1 + math.exp(-1.5976 * z - 0.07056 * z**3))


def evidence(hit):
    """The battery in plain Python."""
    body = hit.rstrip("=")
    code, alphabet = body.translate(str.maketrans("-_", "+/")), UPPER + UPPER.lower() + DIGITS + "+/"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        code, alphabet = body.lower(), DIGITS + "abcdef"
    elif re.fullmatch("[A-Z2-7]+", body):
        alphabet = UPPER + "234567"
    v, n, k = [alphabet.find(c) for c in code], len(code), len(alphabet)
    if not n:
        return 1.0
    parts = [sum(math.floor(a * 8 / k) == p for a in v) for p in range(8)]
    chi = sum((c - n / 8) ** 2 / (n / 8) for c in parts)
    high = sum(a * 2 >= k for a in v)
    changes = sum((a * 2 >= k) != (b * 2 >= k) for a, b in zip(v, v[1:], strict=False))
    mu = 2 * high * (n - high) / n
    runs = abs((changes - mu) / math.sqrt(max(mu * (2 * high * (n - high) - n) / (n * (n - 1)), 1e-9)))
    mean = sum(v) / n
    var = sum((a - mean) ** 2 for a in v)
    serial = abs(
        sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False)) / max(var, 1e-9)
    ) * math.sqrt(n)
    if 2 * (1 - phi(runs)) < 0.01 or 2 * (1 - phi(serial)) < 0.01:
        return 1.0
    return phi((chi - 7 - n) / math.sqrt(2 * (7 + 2 * n)))


def brute(text):
    """All spans (start, kind, end) of a text."""
    text = text or ""
    base = [
        (m.start(), k, m.end())
        for k, (_, pattern, good) in enumerate(BASE) for m in pattern.finditer(text) if good(m)
    ]
    tested = [
        (m.start(), m.end(), evidence(m.group())) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)
    ]
    total, size = sum(e - s for s, e, _ in tested), len(tested)
    weighed = [(s, e, p * total / ((e - s) * size)) for s, e, p in tested]
    ranked = sorted(p for *_, p in weighed)
    limit = max([p for i, p in enumerate(ranked) if p <= 0.01 * (i + 1) / size], default=-1)
    added = [
        (s, 3, e) for s, e, p in weighed
        if p <= limit and not any(a < e and s < b for a, _, b in base)
    ]
    return sorted(base + added)


def written(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def samples():
    rng = random.Random(11)
    b64 = UPPER + UPPER.lower() + DIGITS + "+/"
    parts = [
        "password = ", "Token:", 'secret" : "', "API_KEY='", "apikey=", "passwd", "abcdef", "abc12",
        "AKIA" + "A1" * 8, "AKIA" + "Z" * 15, "AKIAAKIA" + "Q7" * 9, "0123456789abcdef01234567",
        "deadbeef" * 5, " ", "\n", "É😀ſ", "K", ".", "=", "the quick brown fox ", "x" * 30,
        "einheitschaftlicheberufungskeiten", "secret: token: abcdefgh", "key-value/path/of/a/file",
    ]
    out = []
    for _ in range(150):
        take = [rng.choice(parts) for _ in range(rng.randint(0, 14))]
        take += ["".join(rng.choices(b64, k=rng.choice([20, 32, 44, 64]))) for _ in range(rng.randint(0, 2))]
        take += ["".join(rng.choices(UPPER + "234567", k=40))] * rng.randint(0, 1)
        rng.shuffle(take)
        out.append(rng.choice(["", " "]).join(take))
    return [*out, None, "", "password=abc" * 700, "token=abcdef1 " * 900]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i if i else None, t, "x") for i, t in enumerate(samples())]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_equals_brute_force(found):
    got = {r.doc_id: r for r in S.report(found).collect()}
    kinds = set()
    for i, text in enumerate(samples()):
        r, want = got[i or None], brute(text)
        assert r.spans == written(want), text
        base = [s for s in want if s[1] < 3]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
        kinds |= {s[1] for s in want}
    assert kinds == {0, 1, 2, 3}


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(12)
    b64 = UPPER + UPPER.lower() + DIGITS + "+/"
    key = ["".join(rng.choices(b64, k=44)) for _ in range(200)]
    word = [
        "".join(rng.choices(["ein", "schaft", "ung", "heit", "ver", "lich", "tion", "ment"], k=7))
        for _ in range(200)
    ]
    df = spark.createDataFrame(
        [(i, f"so {w} it is") for i, w in enumerate(key + word)], "doc_id long, text string"
    )
    n = {r.doc_id: r.n_random for r in S.report(df).collect()}
    assert sum(n[i] for i in range(200)) > 180 and not sum(n[i] for i in range(200, 400))


def test_redaction(found):
    df = S.scan(found, keep=["doc_id"])
    got = {r.doc_id: r.t for r in df.select("doc_id", S.redacted("text", "spans").alias("t")).collect()}
    for i, text in enumerate(samples()):
        spans, want, at = brute(text), "", 0
        merged: list[list[int]] = []
        for a, _, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            want, at = want + text[at:a] + S.MASK, b
        assert got[i or None] == (want + text[at:] if spans else text)


def test_no_python_in_the_plan(found):
    plan = S.report(found)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_table(found):
    assert S.report(found.limit(0)).count() == 0
    assert found.select(S.redacted("text", F.array().cast(f"array<{S._SPAN}>")).alias("t")).count()


def ratio(hit):
    """q of one candidate in plain Python; None for what is plainly written."""
    if re.fullmatch("[+/_=-]*(([A-Z]?[a-z]+|[A-Z]{1,19}|[0-9]{1,19})([+/_=-]+|$))*", hit):
        return None
    body = hit.rstrip("=")
    code, k = body.translate(str.maketrans("-_", "+/")), 64
    alphabet = UPPER + UPPER.lower() + DIGITS + "+/"
    v = [alphabet.find(c) for c in code]
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        code, k = body.lower(), 16
        v = [(DIGITS + "abcdef").find(c) for c in code]
    elif re.fullmatch("[A-Z2-7]+", body):
        k = 32
        v = [(UPPER + "234567").find(c) for c in code]
    kinds = [UPPER, UPPER.lower(), DIGITS, "+/"]
    out, last = math.log(4), None
    for c in code:
        kind = next((s for s in kinds if c in s), None)
        if kind:
            share = 1 / len(kind)
            if kind in kinds[:2]:
                n = S._LETTERS
                share = 0.9 * n[kind.index(c)] / sum(n) + 0.1 / 26
            out += -math.log(share) - math.log(k)
            if last:
                out += -math.log(0.85 if last == kind else 0.05)
        last = kind
    n, high = len(v), sum(a * 2 >= k for a in v)
    changes = sum((a * 2 >= k) != (b * 2 >= k) for a, b in zip(v, v[1:], strict=False))
    mu = 2 * high * (n - high) / n
    runs = abs((changes - mu) / math.sqrt(max(mu * (2 * high * (n - high) - n) / (n * (n - 1)), 1e-9)))
    mean = sum(v) / n
    var = sum((a - mean) ** 2 for a in v)
    near = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False))
    for z in (runs, abs(near / max(var, 1e-9)) * math.sqrt(n)):
        out += math.log(min(1, max(2 * (1 - phi(min(z, 20))), 1e-12) / 0.01))
    return math.exp(-max(0, out))


def sharp(text):
    text = text or ""
    old = brute(text)
    base = [s for s in old if s[1] < 3]
    tested = [(m.start(), m.end(), ratio(m.group())) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)]
    tested = [t for t in tested if t[2] is not None]
    ranked = sorted(q for *_, q in tested)
    limit = max([q for i, q in enumerate(ranked) if q <= 0.01 * (i + 1) / len(ranked)], default=-1)
    new = [
        (s, 3, e) for s, e, q in tested
        if q <= limit and not any(a < e and s < b for a, _, b in base)
    ]
    return sorted({*old, *new})


def test_sharp_equals_brute_force(found):
    got = {r.doc_id: r.spans for r in S.report(found, sharp=True).collect()}
    more = 0
    for i, text in enumerate(samples()):
        assert got[i or None] == written(sharp(text)), text
        more += len(sharp(text)) > len(brute(text))
    assert more


def test_keys_among_hundreds_of_candidates(spark):
    """One key in each text, among paths, hyphenated words, rule lines and identifiers."""
    rng = random.Random(13)
    b64 = UPPER + UPPER.lower() + DIGITS + "+/"
    words = "the record of every northern station value table model house number water".split()
    many = lambda n, sign: sign.join(rng.choices(words, k=n))
    makers = [
        lambda: "/" + many(5, "/") + "/" + str(rng.randint(1, 99999)), lambda: many(5, "-"),
        lambda: "-" * rng.randint(20, 70), lambda: "=" * 30, lambda: many(6, "_").upper(),
        lambda: "get" + "".join(w.title() for w in rng.choices(words, k=4)) + str(rng.randint(1, 99)),
        lambda: f"/{rng.randint(2000, 2024)}/11/{many(3, '-')}-{rng.randint(1, 10**7)}",
    ]
    rows, keys = [], {}
    for size in (20, 24, 32, 40, 64):
        for _ in range(40):
            parts = [rng.choice(makers)() for _ in range(300)]
            key = "".join(rng.choices(b64, k=size))
            parts.insert(rng.randrange(300), key)
            text = " ".join(parts)
            keys[len(rows)] = (size, text.index(key), len(text))
            rows.append((len(rows), text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in S.report(df, sharp=True).collect()}
    hits, wrong = {}, 0
    for i, (size, at, _) in keys.items():
        key = f"random:{at}:{at + size}"
        hits[size] = hits.get(size, 0) + (key in got[i])
        wrong += sum(s not in ("", key) for s in got[i])
    assert hits[20] >= 30 and all(hits[n] >= 38 for n in (32, 40, 64)) and hits[24] >= 34, hits
    assert wrong <= 0.02 * len(rows), wrong


def test_rule_lines_of_equals_signs(spark):
    key = "q7Zr0TgX9vKd2LmPb8Ns4Hw1YcJf6Ae3"
    rows = [(1, "=" * 30), (2, "a" + "=" * 20), (3, f"{'=' * 40} {key} {'=' * 40}"), (4, "-" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in (False, True):
        got = {r.doc_id: r.spans for r in S.report(df, sharp=how).collect()}
        assert got[1] == got[2] == got[4] == "" and got[3] in ("", "random:41:73")
    assert got[3] == "random:41:73"


def test_long_runs_take_linear_time(spark):
    """Runs of up to a million characters; a key behind them is still found."""
    rng = random.Random(3)
    b64 = UPPER + UPPER.lower() + DIGITS + "+/"
    key = "q7Zr0TgX9vKd2LmPb8Ns4Hw1YcJf6Ae3"
    texts = ["".join(rng.choices(b64, k=n)) for n in (1_000, 1_000_000)] + ["a-" * 300_000, "=" * 500_000]
    took = []
    for text in texts:
        df = spark.createDataFrame([(1, f"{text} {key}")], "doc_id long, text string")
        began = time.time()
        spans = S.report(df, sharp=True).first().spans.split(",")
        took.append(time.time() - began)
        assert f"random:{len(text) + 1}:{len(text) + 33}" in spans
    assert max(took[1:]) < took[0] + 60, took
