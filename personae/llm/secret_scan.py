"""Secret scan: fixed patterns, and a battery of randomness tests for everything else.

All of it is built-in Spark functions over one row at a time: no shuffle, no Python.

Base patterns, leftmost and not overlapping within a kind: ``assign`` (a credential word, a
separator, a value of 6 or more characters), ``access`` (AKIA keys of 20 or more characters)
and ``hex`` (24 or more lower-case hexadecimal digits).

The battery looks at every maximal run of ``SHORTEST`` or more characters of
``[A-Za-z0-9+/_=-]``, infers its encoding (hexadecimal of one case, base32, else base64 in either
alphabet), maps characters to values and tests them:

* chi-squared: counts in 8 equal parts of the alphabet against uniformity;
* runs above and below the middle of the alphabet (Wald-Wolfowitz);
* serial correlation of neighbouring values.

Runs and serial correlation must not reject randomness at ``REJECT``. The chi-squared value
gives the evidence against written text: text leaves at least half of the parts empty, so that
its chi-squared value has a mean of 7 + n or more; p is the probability of one as small as that
measured, which falls with the length. Benjamini-Hochberg over the candidates of a document, with
weights in proportion to their lengths, keeps the false discovery rate below ``RATE``. What is
found is of kind ``random`` unless it meets a base span.

With ``sharp`` a likelihood ratio adds to that, which holds among hundreds of candidates: uniform
characters of the whole inferred alphabet against written text, where a character keeps the class
of the one before (upper case, lower case, digit, sign) with probability ``STAYS`` and letters have
their frequencies in English, a tenth of them spread evenly. Runs and serial correlation take away
what their p-values fall short of ``REJECT``. Under the model of written text the ratio exceeds 1/q
with probability q at most; Benjamini-Hochberg, unweighted, takes q over the candidates that are
not plainly words, numbers, paths or rule lines. Either rule is enough for a candidate; each has
a false discovery rate of ``RATE`` under its own model.

Defined cases: null text is empty and has no spans; offsets are code points, ends exclusive;
repeated or null ids are scanned row by row; other columns are ignored. Prefix sums over matches
work in blocks, so texts with very many matches stay below quadratic time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "random"]
SHORTEST = 20
RATE = 0.01
REJECT = 0.01
STAYS = 0.85
MASK = "[SECRET]"

ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# a run that fails its length fails from every later start in it too, so the length may be
# asked for in the pattern; not so for ASSIGN, whose failing matches hide later ones
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "random": rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}",
}
# words and numbers between signs; longer runs of capitals may be base32, of digits hexadecimal
# possessive, as a long run would need a stack as deep
WRITTEN = "^[+/_=-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]{1,19}+|[0-9]{1,19}+)(?:[+/_=-]++|$))*+$"
# of a to z in English, in thousandths
_LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24,
            2, 20, 1]
_PARTS = 8
_BLOCK = 256
_SPAN = "struct<start:int,kind:int,end:int>"


def _let(fn: Callable[[Column], Column], **values: Column | str) -> Column:
    """``fn`` of a struct of ``values``, each computed once and not again in inner lambdas."""
    bound = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()])
    return F.transform(F.array(bound), fn)[0]


def _fold(values: Column, op: Callable[[Column, Column], Column], n: Column) -> Column:
    """Prefix folds of an int array of ``n`` items, in blocks."""
    zero = F.lit(0)

    def blocks(x: Column) -> Column:
        return F.transform(
            F.sequence(zero, F.floor((x["n"] - 1) / _BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(x["v"], b * _BLOCK + 1, F.lit(_BLOCK)), zero, op),
        )

    def prefixes(x: Column) -> Column:
        def upto(i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            whole = F.aggregate(F.slice(x["blocks"], F.lit(1), b), zero, op)
            return F.aggregate(F.slice(x["v"], b * _BLOCK + 1, i % _BLOCK + 1), whole, op)

        return F.transform(F.sequence(zero, x["n"] - 1), upto)

    folded = _let(
        lambda x: _let(prefixes, v=x["v"], n=x["n"], blocks=blocks(x)), v=values, n=n
    )
    return F.when(n > 0, folded).otherwise(F.array().cast("array<int>"))


def _located(df: DataFrame, kind: str) -> DataFrame:
    """Column ``kind``: the matches with start and end."""
    pattern = F.lit(PATTERNS[kind])
    hits, gaps, steps, starts = (f"_{kind}_{x}" for x in ("hits", "gaps", "steps", "starts"))
    df = df.withColumn(hits, F.regexp_extract_all("_text", pattern, F.lit(0)))
    n = F.size(hits)
    df = df.withColumn(
        gaps,
        F.when(n > 0, F.transform(F.split("_text", pattern, -1), F.length))
        .otherwise(F.array().cast("array<int>")),
    )
    # from the start of one match to the start of the next
    step = _let(
        lambda x: F.transform(
            F.slice(x["gaps"], F.lit(1), F.size(x["hits"])),
            lambda gap, i: gap + F.when(i > 0, F.length(F.get(x["hits"], i - 1))).otherwise(0),
        ),
        gaps=gaps, hits=hits,
    )
    df = df.withColumn(steps, step)
    df = df.withColumn(starts, _fold(F.col(steps), lambda a, x: a + x, n))
    return df.withColumn(
        kind,
        F.transform(
            F.arrays_zip(F.col(hits).alias("hit"), F.col(starts).alias("at")),
            lambda m: F.struct(
                m["hit"].alias("hit"), m["at"].alias("start"),
                (m["at"] + F.length(m["hit"])).alias("end"),
            ),
        ),
    ).drop(hits, gaps, steps, starts)


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(
        matches,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            m["end"].alias("end"),
        ),
    )


def _phi(z: Column) -> Column:
    """Normal distribution function, to about 1e-4."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


_SHARES = [0.9 * n / sum(_LETTERS) + 0.1 / 26 for n in _LETTERS]
_CODES = _UPPER + _LOWER + _DIGIT + "+/"
# -ln of the share of a character in its class
_COSTS = [-math.log(p) for p in [*_SHARES, *_SHARES, *[1 / 10] * 10, *[1 / 2] * 2]]
_CLASSES = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 2


def evidence(hit: Column, sharp: bool = False) -> Column:
    """p against written text of one candidate; 1 if a test of randomness rejects it.

    With ``sharp`` a struct of p and q, which the likelihood ratio gives; q is null for what is
    plainly written.
    """
    return _let(
        lambda x: _let(
            lambda y: _let(
                lambda z: _encoded(z, sharp), hit=y["hit"], body=y["body"], coded=y["coded"],
                alphabet=_alphabet(y["is_hex"], y["is_32"]),
            ),
            hit=x["hit"], body=x["body"], is_hex=x["is_hex"], is_32=x["is_32"],
            coded=F.when(x["is_hex"], F.lower(x["plain"])).otherwise(x["plain"]),
        ),
        # each of these reads the whole run: once, not for each of its characters
        hit=hit, body=_body(hit), is_hex=_body(hit).rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        is_32=_body(hit).rlike("^[A-Z2-7]+$"), plain=F.translate(_body(hit), "-_", "+/"),
    )


def _body(hit: Column) -> Column:
    return F.regexp_replace(hit, "=++$", "")


def _alphabet(is_hex: Column, is_32: Column) -> Column:
    return (
        F.when(is_hex, F.lit(_DIGIT + "abcdef"))
        .when(is_32, F.lit(_UPPER + "234567"))
        .otherwise(F.lit(_UPPER + _LOWER + _DIGIT + "+/"))
    )


def _encoded(x: Column, sharp: bool) -> Column:
    """Evidence of a run whose encoding is known."""
    coded, alphabet = x["coded"], x["alphabet"]
    # '=' within a run is in no alphabet: its value is -1 and counts for no part
    made = F.struct(
        F.transform(F.split(coded, ""), lambda c: F.position(c, alphabet) - 1).alias("v"),
        F.length(alphabet).alias("k"), F.length(coded).cast("double").alias("n"),
    )
    short = F.length(x["body"]) < 2  # '=' only, or after one character
    if not sharp:
        p = F.transform(F.array(made), lambda m: _parts(m))[0]
        return F.when(short, F.lit(1.0)).otherwise(p)
    codes = F.transform(F.split(coded, ""), lambda c: F.position(c, F.lit(_CODES)) - 1)
    found = _let(
        lambda y: F.transform(F.array(y["made"]), lambda m: _parts(m, y["codes"]))[0],
        made=made, codes=codes,
    )
    both = _let(
        lambda y: F.struct(
            y["found"]["p"].alias("p"), F.when(~y["plain"], y["found"]["q"]).alias("q")
        ),
        found=found, plain=x["hit"].rlike(WRITTEN),
    )
    nothing = F.struct(F.lit(1.0).alias("p"), F.lit(None).cast("double").alias("q"))
    return F.when(short, nothing).otherwise(both)


def _parts(x: Column, codes: Column | None = None) -> Column:
    """Values of one candidate, with what several tests need."""
    v = x["v"]
    more = {} if codes is None else {"codes": codes}
    return _let(
        _battery if codes is None else _both, v=v, k=x["k"], n=x["n"], **more,
        mean=F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / x["n"],
        pairs=F.arrays_zip(
            F.slice(v, F.lit(1), F.size(v) - 1).alias("a"),
            F.slice(v, F.lit(2), F.size(v)).alias("b"),
        ),
    )


def _ratio(x: Column) -> Column:
    """ln of the likelihood of uniform characters over that of written text."""
    costs, classes = (F.array(*map(F.lit, values)) for values in (_COSTS, _CLASSES))
    cost = lambda c: F.when(c < 0, 0.0).otherwise(F.get(costs, c) - F.log(x["k"]))

    def move(a: Column, b: Column) -> Column:
        same = F.get(classes, a) == F.get(classes, b)
        step = F.when(same, -math.log(STAYS)).otherwise(-math.log((1 - STAYS) / 3))
        return F.when((a < 0) | (b < 0), 0.0).otherwise(step)  # '=' tells nothing

    codes = x["codes"]
    first = F.aggregate(codes, F.lit(math.log(4)), lambda a, c: a + cost(c))
    pairs = F.arrays_zip(
        F.slice(codes, F.lit(1), F.size(codes) - 1).alias("a"),
        F.slice(codes, F.lit(2), F.size(codes)).alias("b"),
    )
    return first + F.aggregate(pairs, F.lit(0.0), lambda a, p: a + move(p["a"], p["b"]))


def _both(x: Column) -> Column:
    runs, serial, p = _tests(x)
    short = [
        F.log(F.least(F.lit(1.0), F.greatest(2 * (1 - _phi(z)), F.lit(1e-12)) / REJECT))
        for z in (runs, serial)
    ]
    agrees = (2 * (1 - _phi(runs)) >= REJECT) & (2 * (1 - _phi(serial)) >= REJECT)
    q = F.exp(-F.greatest(F.lit(0.0), _ratio(x) + short[0] + short[1]))
    return F.struct(F.when(agrees, p).otherwise(F.lit(1.0)).alias("p"), q.alias("q"))


def _battery(x: Column) -> Column:
    runs, serial, p = _tests(x)
    agrees = (2 * (1 - _phi(runs)) >= REJECT) & (2 * (1 - _phi(serial)) >= REJECT)
    return F.when(agrees, p).otherwise(F.lit(1.0))


def _tests(x: Column) -> tuple[Column, Column, Column]:
    """z of runs and of serial correlation, and p of chi-squared against written text."""
    v, k, n, mean, pairs = (x[name] for name in ("v", "k", "n", "mean", "pairs"))
    zero = F.lit(0.0)
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(_PARTS - 1)),
        lambda part: F.size(F.filter(v, lambda a: F.floor(a * _PARTS / k) == part)),
    )
    chi = F.aggregate(
        counts, zero, lambda a, c: a + (c - n / _PARTS) * (c - n / _PARTS) / (n / _PARTS)
    )
    high = F.size(F.filter(v, lambda a: a * 2 >= k)).cast("double")
    low = n - high
    changes = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k)))
    expected = 2 * high * low / n
    spread = F.sqrt(F.greatest(expected * (2 * high * low - n) / (n * (n - 1)), F.lit(1e-9)))
    runs = F.abs((changes - expected) / spread)
    variance = F.aggregate(v, zero, lambda a, b: a + (b - mean) * (b - mean))
    product = F.aggregate(pairs, zero, lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
    serial = F.abs(product / F.greatest(variance, F.lit(1e-9))) * F.sqrt(n)
    text_mean = _PARTS - 1 + n
    return runs, serial, _phi((chi - text_mean) / F.sqrt(2 * (text_mean + n)))


def _discoveries(x: Column, weights: bool) -> Column:
    """Benjamini-Hochberg over the tested candidates of one document, weighted by length."""
    tested = x["tested"]
    total = F.aggregate(tested, F.lit(0.0), lambda a, m: a + (m["end"] - m["start"]))

    def weighed(y: Column) -> Column:
        return F.transform(
            y["tested"],
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                (
                    m["p"] * y["total"] / ((m["end"] - m["start"]) * y["size"])
                    if weights else m["p"]
                ).alias("p"),
            ),
        )

    def kept(y: Column) -> Column:
        ranked = F.array_sort(F.transform(y["weighed"], lambda m: m["p"]))
        passing = F.filter(
            F.transform(ranked, lambda p, i: F.when(p <= RATE * (i + 1) / y["size"], p)),
            lambda p: p.isNotNull(),
        )
        return _let(
            lambda z: F.filter(z["weighed"], lambda m: m["p"] <= z["limit"]),
            weighed=y["weighed"], limit=F.coalesce(F.array_max(passing), F.lit(-1.0)),
        )

    return _let(
        lambda y: _let(kept, weighed=weighed(y), size=y["size"]),
        tested=tested, total=total, size=F.size(tested),
    )


def _each(tested: Column, name: str) -> Column:
    """The candidates with one of the fields of their evidence as p."""
    return F.transform(
        tested,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["p"][name].alias("p")
        ),
    )


def scan(
    df: DataFrame, text_col: str = "text", keep: list[str | Column] | None = None,
    sharp: bool = False,
) -> DataFrame:
    """``keep`` columns of each row with its text and ``spans``, an array of

    (start, kind, end) in that order; ``kind`` indexes ``KINDS``.
    """
    kept = df.select(*(keep or []), F.col(text_col).alias("_source"))
    names = kept.columns[:-1]
    out = kept.withColumn("_text", F.coalesce("_source", F.lit("")))
    for kind in KINDS:
        out = _located(out, kind)
    value = lambda m: F.regexp_extract(m["hit"], ASSIGN, 2)
    out = out.withColumn("assign", F.filter("assign", lambda m: F.length(value(m)) >= 6))
    out = out.withColumn(
        "_base", F.concat(*[_spans(F.col(k), k) for k in KINDS[:3]]).cast(f"array<{_SPAN}>")
    )
    out = out.withColumn(
        "_tested",
        F.transform(
            "random",
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                evidence(m["hit"], sharp).alias("p"),
            ),
        ),
    )
    if sharp:
        ruled = _let(
            lambda x: F.concat(
                _let(lambda y: _discoveries(y, True), tested=_each(x["tested"], "p")),
                _let(
                    lambda y: _discoveries(y, False),
                    tested=F.filter(_each(x["tested"], "q"), lambda m: m["p"].isNotNull()),
                ),
            ),
            tested="_tested",
        )
        at = F.transform(ruled, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
        out = out.withColumn("_found", F.array_distinct(at))
    else:
        out = out.withColumn("_found", _let(lambda x: _discoveries(x, True), tested="_tested"))
    added = _let(
        lambda x: F.filter(
            x["found"],
            lambda m: ~F.exists(
                x["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
            ),
        ),
        found="_found", base="_base",
    )
    return out.withColumn(
        "spans",
        F.array_sort(F.concat("_base", _spans(added, "random").cast(f"array<{_SPAN}>"))),
    ).select(*names, F.col("_source").alias("text"), "spans")


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
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sharp: bool = False
) -> DataFrame:
    """Counts by kind, a digest of the base spans, and all spans written out."""
    found = scan(df, text_col, [F.col(id_col).alias("doc_id")], sharp)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        count(3).alias("n_random"),
    )


def redacted(text: Column | str, spans: Column | str, mask: str = MASK) -> Column:
    """The text with each group of overlapping spans replaced by ``mask``."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    ends = F.transform(spans, lambda s: s["end"])
    reach = _fold(ends, lambda a, x: F.greatest(a, x), F.size(spans))  # furthest end so far

    def joined(x: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(0)
            return F.when(
                (i == 0) | (s["start"] >= before),
                F.concat(F.substring(x["text"], before + 1, s["start"] - before), F.lit(mask)),
            ).otherwise("")

        tail = F.substring(x["text"], F.array_max(x["reach"]) + 1, F.length(x["text"]))
        return F.concat(F.array_join(F.transform(x["spans"], part), ""), tail)

    masked = _let(joined, text=text, spans=spans, reach=reach)
    return F.when(F.size(spans) > 0, masked).otherwise(text)
