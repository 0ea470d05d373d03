import json
import random

import pytest
from pyspark.sql import functions as F

from personae.operators import cache as C
from personae.operators.report import import_stats, resume_rows
from personae.plans import enrich as enrich_module
from personae.plans.enrich import enrich
from personae.plans import sequential
from personae.plans.sequential import decide_in_order
from personae.schema import CREATORS, IDENTITY_CACHE, IDENTITY_CACHE_KEYS, conform, new_creators


# --- the definition, row by row -------------------------------------------------------------


def one_by_one(rows, owners):
    """rows: (id, reads, writes, enriched) in order; owners: {key: identity}, changed in place."""
    out = {}
    for rid, reads, writes, good in rows:
        seen = list(dict.fromkeys(owners[k] for k in reads if k in owners))
        status = "miss" if not seen else "hit" if len(seen) == 1 else "conflict"
        action = identity = None
        if status == "miss" and good and writes:
            there = {owners[k] for k in writes if k in owners}
            if len(there) == 0:
                action, identity = "create", f"new-{rid}"
            elif len(there) == 1:
                action, identity = "add", there.pop()
            if action:
                for k in writes:
                    owners.setdefault(k, identity)
        out[rid] = (status, tuple(seen), action, identity)
    return out


OLD = {("email", "e0"): "old-1", ("username", "u0"): "old-2", ("email", "e1"): "old-2"}


def assert_in_order(spark, rows, shuffle, owners=OLD, hot_rows=3):
    """rows: (read, written, enriched), each with email, username and profile URL, in order."""
    kinds = ("email", "username", "profile_url")
    batch, evidence = [], []
    for i, (read, write, good) in enumerate(rows):
        rid = f"r{i:05d}"
        keys = [[(t, v) for t, v in zip(kinds, r, strict=True) if v] for r in (read, write)]
        batch.append((rid, *keys, good))
        full = [(e, u, v and f"http://{v}") for e, u, v in (read, write)]
        evidence.append((rid, i, *full[0], *full[1], "enriched" if good else "needs_review"))
    owners = dict(owners)
    old = dict(owners)
    stored = spark.createDataFrame([(t, v, o) for (t, v), o in owners.items()],
                                   "key_type string, key_value string, identity_cache_id string")
    expected = one_by_one(batch, owners)
    df = spark.createDataFrame(
        shuffle(evidence),
        "id string, row_index int, n_email string, n_username string, n_profile_url string, "
        "resolved_email string, resolved_social_handle string, resolved_profile_url string, "
        "w_processing_status string")
    decisions, written = decide_in_order(df, stored, F.struct("row_index"), hot_rows=hot_rows)
    named = {r.i: r.id for r in df.select("id", C.identity_id(F.col("id")).alias("i")).collect()}

    def name(identity):
        return f"new-{named[identity]}" if identity in named else identity

    got = {r.id: (r.cache_status, tuple(name(i) for i in r.matched_ids), r.write_action,
                  name(r.write_identity_id)) for r in decisions.collect()}
    for rid, reads, writes, _ in batch:
        if reads or writes:
            assert got.pop(rid) == expected[rid], rid
    assert not got
    added = {(r.key_type, r.key_value): name(r.identity_cache_id) for r in written.collect()}
    assert added == {k: o for k, o in owners.items() if k not in old}


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        email = f"e{rng.randrange(12)}" if rng.random() < 0.6 else None
        user = f"u{rng.randrange(6)}" if rng.random() < 0.6 else None
        url = f"x.com/p{rng.randrange(25)}" if rng.random() < 0.5 else None
        handle = f"u{rng.randrange(6)}" if url and rng.random() < 0.5 else user
        rows.append(((email, user, url), (email, handle, url), rng.random() < 0.6))
    assert_in_order(spark, rows, lambda e: rng.sample(e, len(e)))


@pytest.fixture
def steps(monkeypatch):
    """Counts rounds and doubling steps by the tables that they store."""
    counted = []
    plain = sequential.materialize

    def counting(df, label):
        if label in ("seen", "chain-links"):
            counted.append(label)
        return plain(df, label)

    monkeypatch.setattr(sequential, "materialize", counting)
    return counted


def chain(n, rng=None):
    """Record i shares a key with record i - 1, another one with record i + 1."""
    rows = []
    for i in range(n):
        own = [f"k{i}", f"k{i + 1}"][:: 1 if i % 2 else -1]
        read = write = (*own, None)
        if rng:
            kind = rng.random()
            write = (None, own[1], f"p{i}") if kind < 0.3 else (own[0], None, f"p{i}") if kind < 0.5 else write
        rows.append((read, write, not rng or rng.random() < 0.9))
    return rows


def test_a_long_chain_takes_few_rounds(spark, steps):
    assert_in_order(spark, chain(1000), lambda e: e, hot_rows=10_000)
    assert len(steps) <= 12


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_copies_and_of_other_kinds(spark, seed, steps):
    rng = random.Random(seed)
    rows = [r for r in chain(80, rng) for _ in range(rng.choice([1, 1, 2, 3]))]
    rows = [r for r in rows if rng.random() < 0.97]
    assert_in_order(spark, rows, lambda e: rng.sample(e, len(e)), {("email", "k9"): "old"}, 100)


def test_chains_through_written_keys(spark):
    """Keys that are only written pass the identity on instead of hiding the record."""
    rows = []
    for i in range(40):
        rows.append(((f"e{i}", None, None), (None, f"u{i // 2}" if i % 3 else f"u{i}", f"p{i // 3}"), True))
    assert_in_order(spark, rows, lambda e: e[::-1], {("email", "e7"): "old"}, 100)


# --- end to end ---------------------------------------------------------------------------------

ROWS = [
    # import, row, name, username, email, url
    ("a", 0, "👑 Jane Doe | UGC Creator", "@janedoe", "jane.doe@x.com", None),
    ("a", 1, None, None, "Jane.Doe@x.com ", None),              # hit on the key row 0 wrote
    ("a", 2, None, "tildabrindlewood", None, None),              # username only: review
    ("a", 3, None, None, None, None),                           # nothing: failed
    ("a", 4, None, "@noorvelm", None, "https://www.instagram.com/noorvelm/"),
    ("b", 0, None, "janedoe", "ida.quorvin@x.com", None),       # hit through the username
    ("b", 1, None, "noorvelm", "jane.doe@x.com", None),        # two identities: conflict
    ("b", 2, None, None, "tolmand.marigold94@x.com", "https://linktr.ee/none"),
]
HTML = '<meta property="og:title" content="Noor✨Velm (@noorvelm)">'


@pytest.fixture(scope="module")
def creators(spark, now):
    rows = spark.createDataFrame(
        ROWS, "import_id string, row_index bigint, raw_full_name string, raw_username string, "
              "raw_email string, raw_profile_url string")
    return new_creators(rows, now)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [("https://instagram.com/noorvelm", HTML, "static")],
        "url string, html string, fetched_via string")


@pytest.fixture(scope="module")
def result(creators, dictionary, pages, now):
    return enrich(creators, dictionary, pages=pages, now=now, hot_rows=2)


def by_row(df):
    return {(r.import_id, r.row_index): r for r in df.collect()}


def test_sequential_run(result):
    got = by_row(result.creators)
    jane = got["a", 0]
    assert (jane.resolved_first_name, jane.resolved_last_name, jane.confidence_score) == (
        "Jane", "Doe", 100)
    assert jane.processing_status == "enriched" and jane.resolved_email == "jane.doe@x.com"
    again = got["a", 1]
    assert again.processing_status == "cache_hit" and again.resolved_social_handle == "janedoe"
    assert again.identity_cache_id == jane.identity_cache_id and not again.needs_review
    tilda = got["a", 2]
    assert (tilda.resolved_first_name, tilda.processing_status, tilda.needs_review) == (
        "Tilda", "needs_review", True)
    assert tilda.identity_cache_id is None
    assert got["a", 3].processing_status == "failed" and got["a", 3].needs_review
    noor = got["a", 4]
    assert (noor.confidence_source, noor.resolved_display_name, noor.resolved_platform) == (
        "instagram", "Noor Velm", "instagram")
    assert got["b", 0].processing_status == "cache_hit"
    assert got["b", 0].identity_cache_id == jane.identity_cache_id
    assert got["b", 1].processing_status == "needs_review"
    assert got["b", 2].resolved_first_name == "Marigold"


def test_logs(result):
    logs = {}
    for r in result.logs.orderBy("seq").collect():
        logs.setdefault(r.creator_id, []).append(r)
    ids = {k: r.id for k, r in by_row(result.creators).items()}
    steps = {k: [(x.step, x.status) for x in logs[i]] for k, i in ids.items()}
    assert steps["a", 1] == [
        ("normalized", "success"), ("cache_lookup", "success"), ("final_selection", "success")]
    assert len(steps["a", 0]) == 8 and len(steps["a", 4]) == 9
    assert ("scraped_profile_instagram", "success") in steps["a", 4]
    assert ("scraped_profile_generic", "failed") in steps["b", 2]
    assert steps["a", 3][-1] == ("final_selection", "failed")
    conflict = [x for x in logs[ids["b", 1]] if x.step == "cache_lookup"][0]
    assert conflict.status == "failed"
    assert len(json.loads(conflict.detail)["identityCacheIds"]) == 2
    parsed = [x for x in logs[ids["a", 0]] if x.step == "parsed_full_name"][0]
    assert json.loads(parsed.detail) == {
        "source": "full_name", "firstName": "Jane", "lastName": "Doe", "confidence": 100,
        "meta": {"tokenCount": 2}}
    assert result.snapshots.count() == 1


def test_summary_and_stats(result):
    assert tuple(result.summary().first()) == (8, 0)
    stats = {r.import_id: r for r in import_stats(result.creators).collect()}
    assert stats["a"].processed == 5 and stats["a"].cache_hits == 1
    assert resume_rows(result.creators, result.logs).count() == 0


def test_second_run_hits_what_the_first_cached(result, creators, dictionary, now):
    second = enrich(creators, dictionary, result.new_identities, result.new_keys, now=now)
    first = by_row(result.creators)
    for key, row in by_row(second.creators).items():
        if first[key].identity_cache_id:
            assert row.processing_status == "cache_hit"
            assert row.identity_cache_id == first[key].identity_cache_id
    assert second.new_identities.count() == 0 and second.new_keys.count() == 0


def test_partitioning_changes_nothing(result, creators, dictionary, pages, now):
    again = enrich(creators.repartition(7, F.rand(5)), dictionary, pages=pages, now=now)
    assert sorted(map(str, again.creators.collect())) == sorted(map(str, result.creators.collect()))


def test_snapshot_mode(creators, dictionary, now):
    got = enrich(creators, dictionary, mode="snapshot", now=now)
    rows = by_row(got.creators)
    assert rows["a", 0].processing_status == "enriched"
    assert rows["a", 1].processing_status == "enriched"       # does not see row 0
    assert rows["a", 1].identity_cache_id is None             # came second on its key
    owners = {(r.key_type, r.key_value): r.identity_cache_id for r in got.new_keys.collect()}
    assert owners["email", "jane.doe@x.com"] == rows["a", 0].identity_cache_id


def test_bad_records_do_not_stop_the_run(creators, dictionary, now):
    broken = creators.withColumn(
        "row_index", F.when(F.col("row_index") != 2, F.col("row_index")))
    got = enrich(broken, dictionary, mode="snapshot", now=now)
    assert tuple(got.summary().first()) == (8, 2)
    errors = got.logs.where("step = 'enrich_one'").collect()
    assert {json.loads(e.detail)["error"] for e in errors} == {"row_index is missing"}


def test_identity_link_is_replaced_never_cleared(creators, dictionary, now):
    linked = creators.withColumn("identity_cache_id", F.lit("kept"))
    rows = by_row(enrich(linked, dictionary, mode="snapshot", now=now).creators)
    assert rows["a", 3].identity_cache_id == "kept"
    assert rows["a", 0].identity_cache_id != "kept"


def test_writes_need_one_owner(spark, now):
    keys = spark.createDataFrame(
        [("email", "a@x", "one"), ("username", "bob", "two"), ("email", "c@x", "one")],
        "key_type string, key_value string, identity_cache_id string")
    writers = spark.createDataFrame(
        [("r1", 1, "a@x", "new", None), ("r2", 2, "a@x", "bob", None), ("r3", 3, "n@x", None, None),
         ("r4", 4, "n@x", "other", None), ("r5", 5, "c@x", "new", None)],
        "id string, o int, resolved_email string, resolved_social_handle string, "
        "resolved_profile_url string")
    plan = C.plan_writes(writers, keys, ["o"], hot_rows=2)
    actions = {r.id: r.write_action for r in plan.decisions.collect()}
    assert actions == {"r1": "add", "r3": "create", "r5": "add"}
    owners = {(r.key_type, r.key_value): r.identity_cache_id for r in plan.new_keys.collect()}
    assert owners["username", "new"] == "one" and ("username", "other") not in owners


def test_identity_without_free_keys_is_still_created(spark, now):
    keys = spark.createDataFrame([("email", "a@x", "one", None)],
                                 "key_type string, key_value string, identity_cache_id string, "
                                 "created_at timestamp")
    record = spark.createDataFrame(
        [("new", 1, "a@x", None, None)],
        "write_identity_id string, o int, key_email string, key_username string, "
        "key_profile_url string")
    record = record.withColumns(
        {f"resolved_{f}": F.lit(None).cast("string") for f in (
            "first_name", "last_name", "display_name", "platform", "profile_url", "email",
            "social_handle")}
        | {"confidence_score": F.lit(0), "confidence_source": F.lit("manual_override"),
           "pipeline_version": F.lit("1.0.0")})
    cache = conform(spark.createDataFrame([("one",)], "id string"), IDENTITY_CACHE)
    got_cache, got_keys = C.create_identities(
        cache, conform(keys, IDENTITY_CACHE_KEYS), record, ["o"], now)
    assert {r.id for r in got_cache.collect()} == {"one", "new"}
    assert {r.identity_cache_id for r in got_keys.collect()} == {"one"}


def test_repeated_ids_are_errors(spark, dictionary, now):
    rows = conform(new_creators(spark.createDataFrame(
        [("imp", i, f"jane.doe{i}@x.com") for i in range(4)],
        "import_id string, row_index bigint, raw_email string"), now), CREATORS)
    same = rows.withColumn("id", F.when(F.col("row_index") < 2, F.lit("twice")).otherwise(F.col("id")))
    got = enrich(same, dictionary, mode="snapshot", now=now)
    assert got.creators.count() == 4
    errors = got.logs.where("step = 'enrich_one'").collect()
    assert [(r.creator_id, json.loads(r.detail)["error"]) for r in errors] == [("twice", "id is repeated")] * 2


def test_runs_have_logs_of_their_own(creators, dictionary, now):
    """Two runs without a name share no log id; a named run gives the same ids again."""
    one, two = (enrich(creators, dictionary, now=now).logs for _ in range(2))
    assert not {r.id for r in one.collect()} & {r.id for r in two.collect()}
    one, two = (enrich(creators, dictionary, now=now, run_id="x").logs for _ in range(2))
    assert {r.id for r in one.collect()} == {r.id for r in two.collect()}


@pytest.mark.parametrize("mode", ["snapshot", "sequential"])
def test_results_are_stored_without_what_only_logs_show(spark, dictionary, now, monkeypatch, mode):
    stored = {}

    def storing(df, label):
        stored[label] = df.columns
        return plain(df, label)

    plain = enrich_module.materialize
    monkeypatch.setattr(enrich_module, "materialize", storing)
    rows = new_creators(spark.createDataFrame(
        [("i", 1, "Jane Doe", "janedoe1@example.com"), ("i", 2, None, "janedoe1@example.com")],
        "import_id string, row_index bigint, raw_full_name string, raw_email string"), now)
    result = enrich(rows, dictionary, mode=mode, now=now, run_id="r")
    assert not {"cand_full_name", "n_email", "raw_snapshot"} & set(stored["enriched"])
    assert "og_title" not in stored["evidence"]
    assert result.logs.where("step = 'parsed_full_name' AND status = 'success'").count() == 1
    assert result.creators.where("processing_status = 'failed'").count() == 0
