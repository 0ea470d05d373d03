import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from personae.config import DEFAULT_DESCRIPTORS, DESCRIPTORS
from personae.functions import keys as K
from personae.functions import labels as L
from personae.functions import text as T

def script(word):
    """The word in mathematical bold script."""
    return "".join(
        chr(ord(c) + (0x1D4D0 - 65 if c.isupper() else 0x1D4EA - 97)) for c in word)


CLEAN = [
    ("Jane   Doe 🌟 | Lifestyle Creator", "Jane Doe"),
    ("John////Smith -- CEO", "John/Smith"),
    ("Ruben Ostler, Founder", "Ruben Ostler"),
    ("ZORV", "Zorv"),
    ("gladyeah", "Gladyeah"),
    ("McKellar", "McKellar"),
    (script("Clementa"), "Clementa"),
    ("👑 Ingrid | UGC Creator", "Ingrid"),
    ("Dr. Marigold Lee", "Marigold Lee"),
    ("Frieda | Mom of 3", "Frieda"),
    ("John 🚀 Travel Creator", "John"),
    ("Anton | Fitness | Coach", "Anton"),
    ("Noor✨Velm", "Noor Velm"),
    ("o'brien-smith", "O'Brien-Smith"),
    ("José ÁLVAREZ", "Jose ALVAREZ"),
    ("Williams", "Willia"),  # a one-word name that ends in a descriptor loses it
    ("👍🏽 Zoë", "Zoe"),
    (" Ana ", "Ana"),
    ("Émom Lee", "Emom Lee"),
    ("she/her", ""),
    ("", ""),
    (None, None),
]


def test_clean_name(apply):
    assert apply(T.clean_name, [c[0] for c in CLEAN]) == [c[1] for c in CLEAN]


def test_with_clean_names_equals_column_function(spark):
    df = spark.createDataFrame([(c[0],) for c in CLEAN], "v string")
    got = [r.n for r in T.with_clean_names(df, {"n": "v"}).collect()]
    assert got == [c[1] or None for c in CLEAN]


def folded(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F)


def test_fold_unicode_equals_nfkd(apply):
    rng = random.Random(1)
    pool = [chr(c) for r in ((0x20, 0x250), (0x1E00, 0x2000), (0x2100, 0x2190), (0xAC00, 0xAC60),
                             (0xD700, 0xD7A4), (0xFB00, 0xFB07), (0xFF00, 0xFF60),
                             (0x1D400, 0x1D500)) for c in range(*r)]
    texts = ["".join(rng.choices(pool, k=6)) for _ in range(400)]
    texts += [c + "x" for c in pool]
    assert apply(T.fold_unicode, texts) == [folded(t) for t in texts]


def python_suffix(s):
    for d in sorted((re.sub("[^a-z]", "", d) for d in DESCRIPTORS), key=len, reverse=True):
        if s.lower().endswith(d) and len(s) - len(d) >= 2:
            return s[: len(s) - len(d)]
    return s


def test_strip_descriptor_suffix_takes_the_longest(apply):
    rng = random.Random(2)
    ends = [re.sub("[^a-z]", "", d) for d in DESCRIPTORS]
    texts = ["".join(rng.choices("abms _.", k=rng.randint(0, 3)))
             + "".join(rng.choices(ends, k=rng.randint(0, 2))) for _ in range(500)]
    assert apply(T.strip_descriptor_suffix, texts) == [python_suffix(t) for t in texts]


@settings(max_examples=15, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aBc '-éZ1", max_size=8), min_size=1, max_size=20))
def test_title_case(apply, texts):
    def expected(t):
        letters = re.sub("[^a-zA-Z]", "", t)
        if not letters or not (letters.isupper() or letters.islower()):
            return t
        return re.sub(r"(^|[\s'-])([a-z])", lambda m: m[1] + m[2].upper(), t.lower())

    assert apply(T.title_case_if_shouty, texts) == [expected(t) for t in texts]


def test_tokens(apply):
    got = apply(T.tokens, ["mary.jane_watson13", "__12ab34--", "", "a1b2"])
    assert got == [["mary", "jane", "watson"], ["ab"], [], ["a1b"]]


def test_canonical_keys(apply):
    assert apply(K.canonical_email, ["  Ida.Quorvin@Gmail.com "]) == ["ida.quorvin@gmail.com"]
    assert apply(K.canonical_username, ["@Karov", " @@x"]) == ["karov", "@x"]
    urls = {
        "https://WWW.Instagram.com/Karov/": "instagram.com/karov",
        "http://instagram.com/karov": "instagram.com/karov",
        "https://user:pw@x.com:8080/A//?q=1#f": "x.com/a",
        "https:instagram.com/karov": "instagram.com/karov",
        "  @karov/ ": "@karov",
        "instagram.com/Karo/": "instagram.com/karo",
        "mailto:Karo": "karo",
        "https://x.com": "x.com",
        "https://x.com/José <b>/": "x.com/jos%c3%a9%20%3cb%3e",
        "https://x.com/É": "x.com/%c3%89",
        "José ": "josé",
        "": "",
    }
    assert apply(K.canonical_profile_url, list(urls)) == list(urls.values())


@pytest.mark.parametrize(
    "url,platform",
    [
        ("https://www.instagram.com/x", "instagram"), ("https://m.tiktok.com/@x", "tiktok"),
        ("https://fb.com/x", "facebook"), ("https://www.youtube.com/@x", "youtube"),
        ("https://youtu.be/abc123", "youtube"), ("https://sub.youtu.be/abc", "generic"),
        ("https://linktr.ee/x", "generic"), ("not a url", "generic"), (None, "generic"),
        ("https://notinstagram.com/x", "generic"),
    ],
)
def test_platform(apply, url, platform):
    assert apply(K.platform_of, [url]) == [platform]


def test_identity_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [("A@B.com", "@Karo", "https://www.instagram.com/karo/"), (None, " ", None),
         ("a@b.com", None, None)], "e string, u string, p string")
    rows = df.select(K.identity_keys(F.col("e"), F.col("u"), F.col("p")).alias("k")).collect()
    assert [[tuple(k) for k in r.k] for r in rows] == [
        [("email", "a@b.com"), ("username", "karo"), ("profile_url", "instagram.com/karo")],
        [], [("email", "a@b.com")],
    ]


def test_headers_and_fields(apply):
    assert apply(T.normalize_header, [" Full_Name", "USER--NAME", "a  b"]) == [
        "full name", "user name", "a b"]
    assert apply(T.snake_case, ["socialHandle"]) == ["social_handle"]
    assert apply(lambda c: T.format_epoch_ms(c, "America/New_York"), [0], "bigint") == [
        "1969-12-31 19:00:00"]


def test_labels(apply, spark):
    assert apply(L.confidence_bucket, [None, 100, 90, 89, 70, 69], "int") == [
        None, "high", "high", "medium", "medium", "low"]
    assert apply(L.key_type_label, ["profile_url", "a_b_c"]) == ["profile url", "a b_c"]
    assert apply(L.status_label, ["partially_enriched_x"]) == ["partially enriched x"]
    assert apply(L.evidence_label, ["generic_scrape", None]) == ["Web Profile", "—"]
    assert apply(L.next_action, ["mapped", "completed", "failed"]) == [
        "enrich", "review", "reupload"]
    df = spark.createDataFrame([(95,), (None,), (10,)], "confidence_score int")
    assert L.filter_buckets(df, []).count() == 3
    assert L.filter_buckets(df, ["high", "low"]).count() == 2


def test_descriptors_of_ones_own(apply, tmp_path):
    from personae.config import aliases_from, descriptors_from, weights_from

    (tmp_path / "d.json").write_text('["C++ guru", "painter"]')
    own = descriptors_from(str(tmp_path / "d.json"))
    clean = lambda c: T.clean_name(c, own)
    assert apply(clean, ["Jane Doe, C++ Guru", "Jane Coach", "janepainter", "Ida C# guru"]) == [
        "Jane Doe", "Jane Coach", "Jane", "Ida C# guru"]
    (tmp_path / "w.json").write_text('{"email": 90}')
    weights = weights_from(str(tmp_path / "w.json"))
    assert (weights.email, weights.username) == (90, 60)
    (tmp_path / "a.json").write_text('{"email": ["mail"]}')
    assert aliases_from(str(tmp_path / "a.json")) == {"email": ["mail"]}
    for read, text in ((weights_from, '{"mail": 1}'), (aliases_from, '{"mail": []}')):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(ValueError):
            read(str(tmp_path / "x.json"))


def test_fixed_lists():
    """The lists the oracles share with the engine, pinned by their digests."""
    import hashlib
    import json

    from personae import config as K

    def digest(x):
        return hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:16]

    assert [digest(x) for x in (K.DESCRIPTORS, K.COLUMN_ALIASES, vars(K.DEFAULT_WEIGHTS))] == [
        "b8769a3ebd5343ee", "628f6700fd70d56d", "c61075c9913b0a68"]


ODD = [
    "jane.DOE", "JANE DOE", "o'neil-smith", "MARY\u00a0ANN", "-.-", "", " ", "12ab34_56-x..y", "ab12\u0085",
    "janepilates", "JANEPILATES\n", "jane pilates\u2028", "xmr", "mr", "\U0001F31Fmr", "ÉCOLE coach", "a\tb",
    "İPEK mrs", "it's", "x\u3000y z", None,
]


def test_shortcuts_equal_the_plain_patterns(spark):
    """Patterns that are tried only where they can match give what they gave everywhere."""
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    c, words = F.col("t"), DEFAULT_DESCRIPTORS
    plain_words = F.filter(F.split(T.js_trim(c), T.WS + "+"), lambda t: t != "")
    plain_tokens = F.filter(
        F.transform(F.split(c, "[._-]+"), lambda t: F.regexp_replace(t, "^[0-9]+|[0-9]+$", "")),
        lambda t: t != "",
    )
    pieces = F.split(F.lower(c), rf"(?<=(?:{T.WS}|['-]))")
    raised = F.array_join(F.transform(pieces, T._first_raised), "")
    pairs = [
        (T.words(c), plain_words),
        (T.tokens(c), plain_tokens),
        (T.strip_descriptor_suffix(c), F.regexp_replace(c, T._suffix_any(words), "$1")),
        (T._without_glued(c, words), F.regexp_replace(c, T._suffix_one_word(words), "$1")),
        (T.title_case_if_shouty(c),
         F.when(c.rlike("[a-z]") != c.rlike("[A-Z]"), raised).otherwise(c)),
    ]
    for row in df.select("t", *[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs]).collect():
        for pair in row[1:]:
            assert pair.a == pair.b, row
