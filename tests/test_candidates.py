import json

import pytest
from pyspark.sql import functions as F

from personae.operators import extract as E
from personae.operators.dictionary import NameDictionary
from personae.operators.profile import attach_pages, page_fields, with_profile_candidate
from personae.operators.score import score
from personae.functions.html import decode_entities
from personae.sources.pages import usable_pages


@pytest.fixture(scope="module", params=["broadcast", "shuffle"])
def any_dictionary(request, names):
    """Both join strategies have to give the same candidates."""
    if request.param == "broadcast":
        return NameDictionary(names)
    big = NameDictionary(names, broadcast_rows=1, hot_rows=2)
    assert not big.small
    return big


def frame(spark, values, column):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], f"id string, {column} string")


def candidates(df, column):
    return [r[column] for r in df.orderBy(F.col("id").cast("int")).collect()]


def test_full_name(spark):
    df = E.with_full_name_candidate(
        frame(spark, [None, "Jane Doe", "Ottilie", "Mary Jane Watson"], "n_full_name"))
    none, two, one, three = candidates(df, "cand_full_name")
    assert none is None
    assert (two.first_name, two.last_name, two.confidence) == ("Jane", "Doe", 100)
    assert (one.first_name, one.last_name) == ("Ottilie", None)
    assert (three.first_name, three.last_name) == ("Mary", "Watson")
    assert json.loads(three.meta) == {"tokenCount": 3, "droppedMiddleTokens": ["Jane"]}


EMAILS = [
    ("ida.quorvin@gmail.com", "ida", "quorvin", 95, False),
    ("wendel.harbisson13@gmail.com", "wendel", "harbisson", 80, True),
    ("tolmand.marigold94@yahoo.com", "marigold", "tolmand", 95, False),
    ("quorvin.tolmand@gmail.com", "quorvin", "tolmand", 80, True),
    ("corin.nestor@gmail.com", "corin", "nestor", 80, True),
    ("ida123@gmail.com", "ida", None, 80, True),
    ("mary.jane.watson@gmail.com", "mary", "watson", 80, True),
    ("no-at-sign", "no", "sign", 80, True),
]


def test_email(spark, any_dictionary):
    df = E.with_email_candidate(
        frame(spark, [e[0] for e in EMAILS] + [None, "123@x.com", "@x.com"], "n_email"),
        any_dictionary)
    got = candidates(df, "cand_email")
    for c, (_, first, last, confidence, ambiguous) in zip(got, EMAILS):
        assert (c.first_name, c.last_name, c.confidence, c.ambiguous) == (
            first, last, confidence, ambiguous)
    assert got[len(EMAILS):] == [None, None, None]
    assert json.loads(got[2].meta)["orderDetection"] == "last_first"
    assert json.loads(got[6].meta)["droppedMiddleTokens"] == ["jane"]


USERNAMES = [
    ("tildabrindlewood", "Tilda", "Brindlewood", False),
    ("beatricebosworth", "Beatrice", "Bosworth", False),
    ("gladyeahpilates", "@gladyeahpilates", None, True),
    ("clementapilates", "Clementa", None, False),
    ("mrs_odette_", "Odette", None, False),
    ("zorvwanders", "@zorvwanders", None, True),
    ("jane.doe", "Jane", "Doe", False),
    ("doe_jane99", "Jane", "Doe", False),
    ("locks.andcurls", "@locks.andcurls", None, True),
    ("TildaBrindlewood", "Tilda", "Brindlewood", False),
    ("sybilaabc", "@sybilaabc", None, True),     # three letters are no surname
    ("Jane", "Jane", None, False),
]


def test_username(spark, any_dictionary):
    df = E.with_username_candidate(
        frame(spark, [u[0] for u in USERNAMES] + [None, "123", "mr.dr.", "  "], "n_username"),
        any_dictionary)
    got = candidates(df, "cand_username")
    for c, (_, first, last, fallback) in zip(got, USERNAMES):
        assert (c.first_name, c.last_name, c.handle_fallback, c.confidence) == (
            first, last, fallback, 60)
    assert got[len(USERNAMES):] == [None, None, None, None]


PAGES = [
    ("https://www.instagram.com/karov/",
     '<meta property="og:title" content="Karo V (@karov)"><meta property="og:description" content="hi">'),
    ("https://linktr.ee/jane", "<title>Jane's Linktree</title>"),
    ("https://www.instagram.com/torbensdavid/",
     '<meta property="og:title" content="Torben Mirkov David (@torbensdavid)">'),
    ("https://www.instagram.com/janedoe/", '<meta property="og:title" content="Instagram">'),
    ("https://www.facebook.com/janedoe", "<title>Log into Facebook</title>"),
    ("https://www.instagram.com/noorvelm/",
     '<META content="Noor✨Velm (@noorvelm)" property="og:title"/>'),
    ("https://www.instagram.com/locks.andcurls/",
     "<meta property='og:title' content='San Diego Hairstylist (@locks.andcurls)'>"),
    ("https://www.instagram.com/strong.hill.miles/",
     '<meta property="og:title" content="Greta Holmen | Ultrarunner | Coach (@strong.hill.miles)">'),
    ("https://www.instagram.com/anyhandle/", '<meta name="irrelevant" content="nothing">'),
    ("https://www.facebook.com/jd", '<meta property="og:title" content="Jane Doe">'),
    ("https://www.tiktok.com/@zorv",
     '<!-- <meta property="og:title" content="No"> --><meta property="og:title" content="ZORV (@b)">'),
]


@pytest.fixture(scope="module")
def scraped(spark, dictionary):
    pages = spark.createDataFrame([(u, h, "static") for u, h in PAGES],
                                  "url string, html string, fetched_via string")
    urls = [u for u, _ in PAGES] + ["https://www.instagram.com/gone/", None]
    df = attach_pages(frame(spark, urls, "n_profile_url"), pages, hot_rows=2)
    rows = with_profile_candidate(df, dictionary).collect()
    return {r.n_profile_url: r for r in rows}


def test_profile_candidates(scraped):
    def cand(url):
        return scraped[url].cand_profile

    karo = cand("https://www.instagram.com/karov/")
    assert (karo.source, karo.display_name, karo.social_handle) == ("instagram", "Karo V", "karov")
    assert json.loads(karo.meta)["bio"] == "hi"
    assert cand("https://linktr.ee/jane").source == "generic_scrape"
    assert cand("https://linktr.ee/jane").confidence == 55
    torben = cand("https://www.instagram.com/torbensdavid/")
    assert (torben.first_name, torben.last_name) == ("Torben", "David")
    assert cand("https://www.instagram.com/janedoe/") is None
    assert cand("https://www.facebook.com/janedoe") is None
    noor = cand("https://www.instagram.com/noorvelm/")
    assert (noor.display_name, noor.first_name, noor.business_like) == ("Noor Velm", "Noor", False)
    assert cand("https://www.instagram.com/locks.andcurls/").business_like
    greta = cand("https://www.instagram.com/strong.hill.miles/")
    assert (greta.first_name, greta.last_name, greta.business_like) == ("Greta", "Holmen", False)
    some = cand("https://www.instagram.com/anyhandle/")
    assert (some.first_name, some.handle_fallback, some.confidence) == ("@anyhandle", True, 80)
    assert cand("https://www.facebook.com/jd").source == "facebook"
    assert cand("https://www.tiktok.com/@zorv").first_name == "Zorv"


def test_scrape_outcome(scraped):
    gone = scraped["https://www.instagram.com/gone/"]
    assert (gone.scrape_error, gone.cand_profile, gone.raw_snapshot) == ("page_not_found", None, None)
    assert scraped[None].scrape_platform is None and scraped[None].scrape_error is None
    assert json.loads(scraped["https://linktr.ee/jane"].raw_snapshot) == {
        "ogTitle": None, "title": "Jane's Linktree", "bio": None}
    assert json.loads(scraped["https://www.instagram.com/karov/"].raw_snapshot) == {
        "ogTitle": "Karo V (@karov)", "bio": "hi"}


def test_page_fields_decode_entities(spark):
    html = ('<script>var a="<title>no</title>"</script><title> A &amp; B &#233;&#x1F600;&eacute;'
            '&unknown; &lt;</title><meta property=og:title content="x &quot;y&quot; &#39;z&#39;">')
    r = page_fields(spark.createDataFrame([(html,)], "html string")).first()
    assert r.title == "A & B é😀é&unknown; <"
    assert r.og_title == "x \"y\" 'z'"


def test_usable_pages(spark):
    static = spark.createDataFrame([("a", "x" * 2000), ("b", "x"), ("c", "x")], "url string, html string")
    browser = spark.createDataFrame([("a", "no"), ("b", "yes")], "url string, html string")
    rows = {(r.url, r.fetched_via) for r in usable_pages(static, browser).collect()}
    assert rows == {("a", "static"), ("b", "browser")}


# --- scorer ------------------------------------------------------------------------------

KNOWN = {"sybila", "tilda", "jane", "ida", "philippa", "noor"}


def cand(source, first=None, last=None, confidence=80, display=None, **flags):
    known = any(n and n.lower() in KNOWN for n in (first, last))
    return (source, first, last, display, None, None, flags.get("handle"), flags.get("email"),
            confidence, flags.get("ambiguous", False), flags.get("business", False),
            flags.get("fallback", False), known, None)


CASES = [
    ([], (None, None, 0, "failed", True)),
    ([cand("email", "Jane", "Doe", 95), cand("full_name", "Jane", "Doe", 100)],
     ("full_name", "Jane", 100, "enriched", False)),
    ([cand("email", "ida", "quorvin", 95)], ("email", "Ida", 95, "enriched", False)),
    ([cand("username", "ida123", None, 60)], ("username", "Ida123", 60, "needs_review", True)),
    ([cand("email", "Corin", "Nestor", 80, ambiguous=True)],
     ("email", "Corin", 80, "needs_review", True)),
    ([cand("email", "Karo", "V", 95), cand("instagram", None, None, 80, "Karo V")],
     ("instagram", None, 80, "enriched", False)),
    ([cand("instagram", "K", None, 80, "K"), cand("username", "Tilda", "Brindlewood", 60),
      cand("email", "tildabrindlewood", None, 80)], ("username", "Tilda", 60, "needs_review", True)),
    ([cand("instagram", "San", "Hairstylist", 80, business=True),
      cand("email", "philippa", None, 80, ambiguous=True)],
     ("email", "Philippa", 80, "needs_review", True)),
    ([cand("instagram", "K", None, 80, "K")], ("instagram", "K", 80, "enriched", False)),
    ([cand("full_name", "McKellar", None, 100)], ("full_name", "McKellar", 100, "enriched", False)),
    ([cand("instagram", "Swim.", "Run", 80), cand("username", "Sybila", "Salwaysrunning", 60),
      cand("email", "letsgetfitwithsybila", None, 80, ambiguous=True)],
     ("username", "Sybila", 60, "needs_review", True)),
    ([cand("instagram", "Noor", "Velm", 80), cand("username", "@noorvelm", None, 60, fallback=True)],
     ("instagram", "Noor", 80, "enriched", False)),
    ([cand("username", "@locks.andcurls", None, 60, fallback=True),
      cand("email", "philippa", None, 80, ambiguous=True)],
     ("email", "Philippa", 80, "needs_review", True)),
    # tie at 80 between two last resorts: the earlier one
    ([cand("email", "zed", None, 80, ambiguous=True), cand("instagram", "@zed", None, 80, fallback=True)],
     ("email", "Zed", 80, "needs_review", True)),
    # an @handle from a page alone passes without review
    ([cand("instagram", "@zed", None, 80, fallback=True)],
     ("instagram", "@zed", 80, "enriched", False)),
]


def test_scorer(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)],
                               f"i int, candidates array<{E.CANDIDATE_TYPE}>")
    rows = score(df).orderBy("i").collect()
    got = [(r.w_confidence_source, r.w_first_name, r.w_confidence_score, r.w_processing_status,
            r.w_needs_review) for r in rows]
    assert got == [expected for _, expected in CASES]


def test_scorer_on_columns_equals_array(spark):
    wide = [(i, *(c + [None] * (4 - len(c)))) for i, (c, _) in enumerate(CASES)]
    schema = "i int, " + ", ".join(f"c{n} {E.CANDIDATE_TYPE}" for n in range(4))
    df = spark.createDataFrame(wide, schema)
    rows = score(df, [f"c{n}" for n in range(4)]).orderBy("i").collect()
    assert [r.w_confidence_source for r in rows] == [e[0] for _, e in CASES]


def test_no_email_backfill_from_a_loser(spark):
    both = [cand("full_name", "Jane", "Doe", 100), cand("email", "Jane", "Doe", 95, email="j@x.com")]
    df = spark.createDataFrame([(both,)], f"candidates array<{E.CANDIDATE_TYPE}>")
    assert score(df).first().w_email is None


def test_numeric_references_of_any_length(apply):
    given = ["&#x000000041;", "&#000000000065;", "&#x110000;", "&#99999999999;", "&#0;", "&#xD800;"]
    assert apply(decode_entities, given) == ["A", "A", "�", "�", "�", "�"]
