import json
import random

import pytest
from pyspark.sql import functions as F

from personae.operators import integrity as I
from personae.operators import review as V
from personae.operators.dedupe import duplicate_groups, duplicate_members, duplicate_pairs_to_merge
from personae.operators.integrity import delete_identities, delete_imports
from personae.operators.report import creator_timeline, job_progress, next_pending
from personae.plans import export as O
from personae.schema import CREATORS, IDENTITY_CACHE, IDENTITY_CACHE_KEYS, conform, empty


def creators_of(spark, rows):
    """rows: dicts of creators columns; the rest gets plain defaults."""
    base = {"import_id": "imp", "processing_status": "enriched", "pipeline_version": "1.0.0",
            "needs_review": True, "review_status": "pending"}
    full = [{f.name: None for f in CREATORS.fields} | base | {"row_index": i} | r
            for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in CREATORS.fields) for r in full], CREATORS)


def by_id(df):
    return {r.id: r for r in df.collect()}


# --- approve / ignore ----------------------------------------------------------------------------


def test_last_review_action_wins(spark, now):
    creators = creators_of(spark, [{"id": "a"}, {"id": "b"}, {"id": "c"}])
    actions = spark.createDataFrame(
        [(1, "a", "approve"), (2, "a", "ignore"), (3, "b", "approve"), (4, "b", "delete"),
         (5, "zz", "approve")], "seq bigint, creator_id string, action string")
    got = V.apply_review(creators, actions, now, "r", hot_rows=1)
    assert {i: r.review_status for i, r in by_id(got.creators).items()} == {
        "a": "ignored", "b": "approved", "c": "pending"}
    assert sorted(r.step for r in got.logs.collect()) == [
        "review_approved", "review_approved", "review_ignored"]
    assert {r.seq: r.reject_reason for r in got.rejects.collect()} == {
        4: "unknown_action", 5: "no_such_record"}


def test_bulk_selection(spark, now):
    creators = creators_of(spark, [{"id": "a"}, {"id": "b", "needs_review": False}, {"id": "c"}])
    chosen = V.bulk_actions(creators, F.col("needs_review"), "approve")
    got = by_id(V.apply_review(creators, chosen, now, "r").creators)
    assert {i for i, r in got.items() if r.review_status == "approved"} == {"a", "c"}


# --- overrides ------------------------------------------------------------------------------------


def test_overrides(spark, now):
    creators = creators_of(spark, [
        {"id": "a", "resolved_first_name": "Old", "identity_cache_id": "idn",
         "confidence_score": 60, "resolved_email": "a@x.com"},
        {"id": "b", "resolved_first_name": "Bea", "raw_username": "@bea", "raw_email": "taken@x.com"},
        {"id": "c", "resolved_first_name": "Cy", "identity_cache_id": "idn"},
        {"id": "d"},
    ])
    cache = conform(spark.createDataFrame([("idn", "Cached")], "id string, first_name string"),
                    IDENTITY_CACHE)
    keys = conform(spark.createDataFrame([("idn", "email", "taken@x.com")],
                                         "identity_cache_id string, key_type string, key_value string"),
                   IDENTITY_CACHE_KEYS)
    actions = spark.createDataFrame(
        [(1, "a", "firstName", "One", None), (2, "a", "firstName", "Two", "typo"),
         (3, "a", "email", "new@x.com", None), (4, "b", "lastName", "Bee", None),
         (5, "c", "firstName", "Three", None), (6, "a", "age", "5", None),
         (7, "a", "email", "  ", None), (8, "nobody", "email", "x", None)],
        "seq bigint, creator_id string, field string, value string, reason string")
    got = V.apply_overrides(creators, cache, keys, actions, now, "r", hot_rows=2)
    rows = by_id(got.creators)
    a = rows["a"]
    assert (a.resolved_first_name, a.resolved_email, a.confidence_score, a.confidence_source) == (
        "Two", "new@x.com", 100, "manual_override")
    assert (a.processing_status, a.needs_review, a.review_status) == ("enriched", False, "approved")
    assert rows["d"].review_status == "pending" and rows["d"].needs_review
    cached = by_id(got.identity_cache)
    assert cached["idn"].first_name == "Three" and cached["idn"].verified   # last by seq
    assert cached["idn"].email == "new@x.com"
    fallback = cached[rows["b"].identity_cache_id]
    assert (fallback.first_name, fallback.last_name, fallback.confidence_score,
            fallback.confidence_source) == ("Bea", "Bee", 0, "manual_override")
    owners = {(r.key_type, r.key_value): r.identity_cache_id for r in got.identity_cache_keys.collect()}
    assert owners == {("email", "taken@x.com"): "idn",
                      ("username", "bea"): rows["b"].identity_cache_id}
    audit = sorted((r.field, r.old_value, r.new_value, r.reason) for r in got.manual_overrides.collect()
                   if r.identity_cache_id == "idn" and r.new_value != "Three")
    assert audit == [("email", "a@x.com", "new@x.com", None), ("firstName", "Old", "One", None),
                     ("firstName", "One", "Two", "typo")]
    assert {r.seq for r in got.rejects.collect()} == {6, 7, 8}


# --- merges ----------------------------------------------------------------------------------------

COPIED = ["resolved_first_name", "resolved_email", "confidence_score", "processing_status"]


def merge_one_by_one(state, pairs):
    state = {i: dict(r) for i, r in state.items()}
    logs = []
    for _, s, t in sorted(pairs):
        if s == t or s not in state or t not in state:
            continue
        src, tgt = state[s], state[t]
        logs.append((s, t, src["resolved_first_name"]))
        for c in COPIED:
            src[c] = tgt[c]
        src["confidence_score"] = tgt["confidence_score"] or 0
        src["identity_cache_id"] = tgt["identity_cache_id"] or src["identity_cache_id"]
        src["duplicate_of_creator_id"] = t
    return state, logs


def assert_merged_in_order(spark, now, rows, pairs, hot_rows=3):
    expected, logs = merge_one_by_one({r["id"]: r for r in rows}, pairs)
    got = V.merge_duplicates(
        creators_of(spark, rows),
        spark.createDataFrame(pairs, "seq bigint, source_id string, target_id string"), now,
        "r", hot_rows=hot_rows)
    for i, r in by_id(got.creators).items():
        for c in [*COPIED, "identity_cache_id", "duplicate_of_creator_id"]:
            assert r[c] == expected[i][c], (i, c)
    got_logs = sorted(
        (r.seq, r.creator_id, json.loads(r.detail)["targetCreatorId"],
         json.loads(r.detail)["preMergeSnapshot"]["resolvedFirstName"]) for r in got.logs.collect())
    assert [x[1:] for x in got_logs] == logs


def some_rows(rng, n, linked=0.5):
    return [{"id": f"c{i}", "resolved_first_name": f"n{i}", "resolved_email": f"e{i}",
             "confidence_score": rng.choice([None, 50, 95]),
             "identity_cache_id": f"idn{i}" if rng.random() < linked else None,
             "duplicate_of_creator_id": None,
             "processing_status": rng.choice(["enriched", "needs_review"])} for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_merges_equal_one_by_one(spark, now, seed):
    rng = random.Random(seed)
    n = [8, 8, 30][seed]
    pairs = [(k, f"c{rng.randrange(n)}", f"c{rng.randrange(n + 1)}") for k in range(9 * (seed + 1))]
    assert_merged_in_order(spark, now, some_rows(rng, n, 0.3), pairs)


def test_long_chains_of_merges_take_few_steps(spark, now, monkeypatch):
    stored = []
    plain = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, label: stored.append(label) or plain(df, label))
    rng = random.Random(5)
    pairs = [(k, f"c{k}", f"c{k - 1}") for k in range(1, 200)]
    # a few sources are merged once more, in the middle and at the end
    pairs += [(1000 + k, f"c{k}", f"c{199 - k}") for k in (3, 50, 120)]
    assert_merged_in_order(spark, now, some_rows(rng, 200, 0.02), pairs, hot_rows=1000)
    assert stored.count("merge-steps") <= 2 * 10


def test_unmerge_restores_the_record(spark, now):
    creators = creators_of(spark, [
        {"id": "a", "resolved_first_name": "A", "confidence_score": 60, "confidence_source": "username",
         "review_status": "ignored", "processing_status": "needs_review", "needs_review": True},
        {"id": "b", "resolved_first_name": "B", "confidence_score": 95, "identity_cache_id": "idn",
         "needs_review": False},
        {"id": "c", "duplicate_of_creator_id": "b"},
    ])
    pairs = spark.createDataFrame([(1, "a", "b")], "seq bigint, source_id string, target_id string")
    merged = V.merge_duplicates(creators, pairs, now, "r")
    a = by_id(merged.creators)["a"]
    assert (a.resolved_first_name, a.review_status, a.duplicate_of_creator_id) == ("B", "approved", "b")
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "zz")],
                                  "seq bigint, creator_id string")
    undone = V.unmerge(merged.creators, merged.logs, asked, now, "u")
    before, after = by_id(creators)["a"], by_id(undone.creators)["a"]
    changed = {c for c in creators.columns if before[c] != after[c]}
    # the link of the target stays, as links are never cleared
    assert changed == {"identity_cache_id", "updated_at"} and after.identity_cache_id == "idn"
    assert {r.seq: r.reject_reason for r in undone.rejects.collect()} == {
        2: "not_merged", 3: "not_merged",
        4: "no_merge_on_record", 5: "no_such_record"}
    log = undone.logs.first()
    assert json.loads(log.detail)["restoredFrom"] == merged.logs.first().id


# --- duplicates ------------------------------------------------------------------------------------


def test_duplicates(spark):
    creators = creators_of(spark, [
        {"id": "a", "raw_email": "Jane@Example.com", "raw_username": "alice"},
        {"id": "b", "resolved_email": "jane@example.com", "raw_email": "other@x.com"},
        {"id": "c", "raw_username": "@Karov", "raw_profile_url": "https://www.instagram.com/karov/"},
        {"id": "d", "raw_username": "karov", "raw_profile_url": "http://instagram.com/karov"},
        {"id": "e", "raw_email": "jane@example.com", "import_id": "other"},
        {"id": "f", "raw_email": "jane@example.com", "duplicate_of_creator_id": "a"},
        {"id": "g", "raw_email": "  "}, {"id": "h", "raw_email": "  "},
        {"id": "i", "raw_email": "jane@example.com"},
    ])
    groups = {(r.key_type, r.key_value): (r["size"], r.first_creator_id)
              for r in duplicate_groups(creators).collect()}
    assert groups == {("email", "jane@example.com"): (3, "a"), ("username", "karov"): (2, "c"),
                      ("profile_url", "instagram.com/karov"): (2, "c")}
    members = duplicate_members(creators, hot_rows=1).where("key_type = 'email'")
    assert [r.creator_id for r in members.orderBy("row_index").collect()] == ["a", "b", "i"]
    pairs = duplicate_pairs_to_merge(creators).where("key_type = 'email'").collect()
    assert {(p.source_id, p.target_id) for p in pairs} == {("b", "a"), ("i", "a")}


# --- export, integrity, reports ---------------------------------------------------------------------


def test_export(spark, tmp_path):
    creators = creators_of(spark, [
        {"id": "a", "resolved_first_name": 'Jane "J", D', "resolved_email": "j@x.com", "notes": "n"},
        {"id": "b", "review_status": "ignored"}, {"id": "c", "duplicate_of_creator_id": "a"},
        {"id": "d", "resolved_first_name": "Dee", "needs_review": False, "confidence_score": 95},
    ])
    full = O.export_rows(creators, "full", 42)
    assert full.columns == [
        "firstName", "email", "socialHandle", "lastName", "displayName", "platform", "profileUrl",
        "confidenceScore", "confidenceSource", "processingStatus", "needsReview", "reviewStatus",
        "pipelineVersion", "exportedAt", "notes"]
    assert {r.exportedAt for r in full.collect()} == {42}
    history = O.write_export(creators, "imp", "quick", str(tmp_path), 42, single_file=True).first()
    assert (history.row_count, history.file_name) == (2, "export-quick-imp-42.csv")
    assert [f.name for f in tmp_path.iterdir()] == ["export-quick-imp-42.csv"]
    back = spark.read.csv(str(tmp_path / "export-quick-imp-42.csv"), header=True, escape='"').collect()
    assert [r.firstName for r in back] == ['Jane "J", D', "Dee"]
    with pytest.raises(ValueError):
        O.export_rows(creators, "other", 0)


def test_one_file_from_many_ranges(spark, tmp_path):
    rows = [{"id": f"r{k}", "row_index": (k * 7919) % 500, "resolved_first_name": f"n{k}"}
            for k in range(500)]
    target = tmp_path / "export-quick-imp-1.csv"
    target.write_text("older and longer " * 5_000)
    creators = creators_of(spark, rows).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        O.write_export(creators, "imp", "quick", str(tmp_path), 1, single_file=True)
        none = O.write_export(creators, "other", "quick", str(tmp_path), 1, single_file=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = target.read_text().split("\n")
    order = sorted(range(500), key=lambda k: (k * 7919) % 500)
    assert lines == ["firstName,email,socialHandle", *[f"n{k},," for k in order], ""]
    assert none.first().row_count == 0
    assert (tmp_path / "export-quick-other-1.csv").read_text() == "firstName,email,socialHandle\n"


def test_markers_of_several_deletes(spark):
    creators = creators_of(spark, [
        {"id": "a", "import_id": "gone"}, {"id": "b", "duplicate_of_creator_id": "a"},
        {"id": "c", "duplicate_of_creator_id": "b"}, {"id": "d", "import_id": None}])
    tables = {
        "import_history": spark.createDataFrame([("gone",), ("imp",), (None,)], "id string"),
        "creators": creators,
        "processing_logs": spark.createDataFrame(
            [("a",), ("b",), ("c",), ("c",), (None,)], "creator_id string")}
    ids = lambda *found: spark.createDataFrame([(i,) for i in found], "id string")
    markers = I.merge_markers(
        I.mark_deleted(tables, "import_history", ids("gone", "gone", None, "unknown")),
        I.mark_deleted(tables, "creators", ids("b")))
    left = {name: I.live(name, t, markers, hot_rows=1) for name, t in tables.items()}
    assert {r.id: r.duplicate_of_creator_id for r in left["creators"].collect()} == {
        "c": None, "d": None}
    assert [r.creator_id for r in left["processing_logs"].orderBy("creator_id").collect()] == [
        None, "c", "c"]
    assert {r.id for r in left["import_history"].collect()} == {"imp", None}
    assert left["creators"].columns == creators.columns
    plan = left["processing_logs"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "hashpartitioning" not in plan


def test_large_markers_are_joined_by_salts(spark, monkeypatch):
    monkeypatch.setattr(I, "fits_broadcast", lambda df: False)
    logs = [("a",)] * 5 + [("b",)] * 5 + [(None,)] * 5
    tables = {
        "import_history": spark.createDataFrame([("gone",), ("imp",)], "id string"),
        "creators": creators_of(spark, [{"id": "a", "import_id": "gone"}, {"id": "b"}]),
        "processing_logs": spark.createDataFrame(logs, "creator_id string")}
    left = delete_imports(tables, spark.createDataFrame([("gone",)], "id string"), hot_rows=2)
    kept = [r.creator_id for r in left["processing_logs"].collect()]
    assert sorted(kept, key=str) == [None] * 5 + ["b"] * 5
    assert [r.id for r in left["creators"].collect()] == ["b"]


def test_deletes_follow_the_keys(spark):
    creators = creators_of(spark, [
        {"id": "a", "import_id": "gone", "identity_cache_id": "i1"},
        {"id": "b", "duplicate_of_creator_id": "a", "identity_cache_id": "i1"}, {"id": "c"}])
    logs = spark.createDataFrame([("a",), ("b",)], "creator_id string")
    tables = {
        "import_history": spark.createDataFrame([("gone",), ("imp",)], "id string"),
        "creators": creators, "processing_logs": logs,
        "export_history": spark.createDataFrame([("x", "gone")], "id string, import_id string")}
    left = delete_imports(tables, spark.createDataFrame([("gone",)], "id string"), hot_rows=1)
    assert {r.id: r.duplicate_of_creator_id for r in left["creators"].collect()} == {
        "b": None, "c": None}
    assert [r.creator_id for r in left["processing_logs"].collect()] == ["b"]
    assert left["export_history"].first().import_id is None
    assert left["import_history"].count() == 1
    cached = {
        "identity_cache": spark.createDataFrame([("i1",), ("i2",)], "id string"),
        "identity_cache_keys": spark.createDataFrame([("i1", "email", "k"), ("i2", "email", "l")],
                                                     "identity_cache_id string, key_type string, key_value string"),
        "manual_overrides": spark.createDataFrame([("i1", "f")], "identity_cache_id string, field string"),
        "creators": creators}
    left = delete_identities(cached, spark.createDataFrame([("i1",)], "id string"))
    assert [r.id for r in left["identity_cache"].collect()] == ["i2"]
    assert left["identity_cache_keys"].count() == 1 and left["manual_overrides"].count() == 0
    assert {r.identity_cache_id for r in left["creators"].collect()} == {None}


def test_progress(spark, now):
    creators = creators_of(spark, [{"id": "a"}, {"id": "b"}, {"id": "c", "import_id": "new"}])
    logs = spark.createDataFrame([("a", "final_selection"), ("a", "normalized"), ("b", "normalized")],
                                 "creator_id string, step string").withColumn("created_at", now)
    got = {r.import_id: r for r in job_progress(creators, logs).collect()}
    assert (got["imp"].total_rows, got["imp"].processed_rows, got["imp"].status,
            got["imp"].last_processed_row_index) == (2, 1, "running", 0)
    assert (got["new"].status, got["new"].last_processed_row_index) == ("queued", -1)
    items = spark.createDataFrame(
        [("j", "a", 0, "done", 1), ("j", "b", 1, "failed", 2), ("j", "c", 2, "pending", 0)],
        "job_id string, creator_id string, row_index bigint, status string, attempts int")
    assert next_pending(items).first().creator_id == "b"


def test_timeline_is_ordered(spark):
    logs = spark.createDataFrame(
        [("c", 2, "t2", "success", "{}", "2024-01-01"), ("c", 1, "t1", "success", "{}", "2024-01-01")],
        "creator_id string, seq int, step string, status string, detail string, at string"
    ).withColumn("created_at", F.col("at").cast("timestamp"))
    snaps = spark.createDataFrame([], "creator_id string, fetched_at timestamp, platform string, "
                                      "fetched_via string, raw_snapshot string")
    assert [r.label for r in creator_timeline(logs, snaps).collect()] == ["t1", "t2"]


def test_empty_cache_override(spark, now):
    creators = creators_of(spark, [{"id": "a"}])
    actions = spark.createDataFrame([(1, "a", "firstName", "New", None)],
                                    "seq bigint, creator_id string, field string, value string, reason string")
    got = V.apply_overrides(creators, empty(spark, IDENTITY_CACHE), empty(spark, IDENTITY_CACHE_KEYS),
                            actions, now, "r")
    assert got.identity_cache.first().first_name == "New"
    assert got.identity_cache_keys.count() == 0     # nothing to find it by


def test_actions_need_a_place(spark, now):
    creators = creators_of(spark, [{"id": c} for c in "abcd"])
    pairs = [(1, "a", "b"), (1, "a", "c"), (None, "b", "c"), (3_000_000_000, "c", "d")]
    schema = "seq bigint, source_id string, target_id string"
    got = V.merge_duplicates(creators, spark.createDataFrame(pairs, schema), now, "r")
    assert got.creators.count() == 4
    assert [(r.creator_id, r.seq) for r in got.logs.collect()] == [("c", 3_000_000_000)]
    assert sorted(r.reject_reason for r in got.rejects.collect()) == [
        "seq_missing", "seq_repeated", "seq_repeated"]


def test_runs_have_logs_of_their_own(spark, now):
    creators = creators_of(spark, [{"id": "a"}])
    actions = spark.createDataFrame([(1, "a", "approve")], "seq bigint, creator_id string, action string")
    ids = [V.apply_review(creators, actions, now, run).logs.first().id for run in ("r1", "r2")]
    assert ids[0] != ids[1]


def test_bulk_actions_are_in_order(spark, now):
    creators = creators_of(spark, [{"id": c} for c in "abcdef"]).repartition(3)
    seqs = [r.seq for r in V.bulk_actions(creators, F.lit(True), "approve", 2**33).collect()]
    assert len(set(seqs)) == 6 and min(seqs) >= 2**33
