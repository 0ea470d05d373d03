import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from personae.operators.validate import RULES, Rules, validate
from personae.plans.enrich import enrich
from personae.schema import CREATORS, IMPORT_HISTORY, conform, new_creators
from personae.sources import imports as S
from personae.sources import mapping as M
from personae.sources import records as R
from personae.streaming.incremental import IncrementalEnrichment


def test_csv_ingest(spark, now, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(
        '﻿Full Name,Email,Email,Notes\n'
        'Ida Quorvin,ida@example.com,,"likes, commas"\n\n'
        '"Doe, ""Jane""",j@x.com,k@x.com,"two\nlines"\n'
        ',,last@x.com,\n', encoding="utf-8")
    got = S.ingest_csv(spark, str(path), "imp", now)
    assert got.headers == ["Full Name", "Email", "Email_1", "Notes"]
    rows = got.creators.orderBy("row_index").collect()
    assert [r.row_index for r in rows] == [0, 1, 2]
    assert {(r.processing_status, r.review_status) for r in rows} == {("failed", "pending")}
    payload = [r.p for r in got.creators.orderBy("row_index").select(
        F.from_json("raw_payload", "map<string,string>").alias("p")).collect()]
    assert payload[0] == {"Full Name": "Ida Quorvin", "Email": "ida@example.com", "Email_1": "",
                          "Notes": "likes, commas"}
    assert payload[1]["Full Name"] == 'Doe, "Jane"' and payload[1]["Notes"] == "two\nlines"
    history = got.import_history.first()
    assert (history.row_count, history.file_name, history.status) == (3, "people.csv", "uploaded")

    mapping = M.suggested_mapping(spark, got.headers)
    assert mapping == {"Full Name": "fullName", "Email": "email"}
    mapping = M.edit_mapping(mapping, {"Email_1": "email", "Notes": ""})
    creators, imports, preview = M.confirm_mapping(
        got.creators, got.import_history, "imp", mapping, now)
    assert [r.raw_email for r in creators.orderBy("row_index").collect()] == [
        "ida@example.com", "j@x.com", "last@x.com"]
    assert (imports.first().status, imports.first().row_count) == ("mapped", 3)
    assert preview.orderBy("row_index").first().n_full_name == "Ida Quorvin"


def test_ingest_numbers_part_files_in_order(spark, now, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("n"), F.lit("x").alias("name"))
    df.orderBy("n").repartitionByRange(5, "n").write.option("header", True).csv(str(tmp_path / "in"))
    got = S.ingest_csv(spark, str(tmp_path / "in"), "imp", now)
    pairs = got.creators.select(
        "row_index", F.get_json_object("raw_payload", "$.n").cast("bigint").alias("n")).collect()
    assert all(r.row_index == r.n for r in pairs) and len(pairs) == 2000


def payloads(spark, now, tmp_path, text):
    (tmp_path / "f.csv").write_text(text)
    got = S.ingest_csv(spark, str(tmp_path / "f.csv"), "imp", now)
    rows = got.creators.orderBy("row_index").collect()
    return got.headers, [json.loads(r.raw_payload) for r in rows]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, now, tmp_path, sep):
    text = f'name{sep}"e{sep}mail"\nJane{sep}j@x\n"Doe{sep} Jo"{sep}"a ""b"" c"\n'
    assert payloads(spark, now, tmp_path, text) == (
        ["name", f"e{sep}mail"],
        [{"name": "Jane", f"e{sep}mail": "j@x"}, {"name": f"Doe{sep} Jo", f"e{sep}mail": 'a "b" c'}],
    )


def test_headers_by_position(spark, now, tmp_path):
    headers, rows = payloads(spark, now, tmp_path, "_id,Email,email,a,a,a_1,\n1,2,3,4,5,6,7\n")
    assert headers == ["_id", "Email", "email", "a", "a_1", "a_1_1", ""]
    assert rows == [dict(zip(headers, "1234567", strict=True))]


def test_rows_that_are_longer_or_shorter_than_the_header(spark, now, tmp_path):
    text = 'name,email\nJane,a@x,zzz,"q, ""r"""\nJo\n"two\nlines",b@x,\n  ,\n'
    _, rows = payloads(spark, now, tmp_path, text)
    assert rows == [
        {"name": "Jane", "email": "a@x", S.SURPLUS: ["zzz", 'q, "r"']}, {"name": "Jo", "email": ""},
        {"name": "two\nlines", "email": "b@x", S.SURPLUS: [""]}, {"name": "  ", "email": ""},
    ]


def test_empty_file(spark, now, tmp_path):
    (tmp_path / "e.csv").write_text("")
    got = S.ingest_csv(spark, str(tmp_path / "e.csv"), "imp", now)
    assert got.creators.count() == 0 and got.import_history.first().row_count == 0


def test_mapping_examples(spark):
    headers = ["Full Name", "Email Address", "Instagram", "Handle", "Unrelated Column", "full_name",
               "USER-NAME"]
    assert M.suggested_mapping(spark, headers) == {
        "Full Name": "fullName", "Email Address": "email", "Instagram": "profileUrl",
        "Handle": "username", "full_name": "fullName", "USER-NAME": "username"}
    row = spark.createDataFrame([("", "https://tiktok.com/@ida")], "Instagram string, TikTok string")
    mapped = M.apply_mapping(row, {"Instagram": "profileUrl", "TikTok": "profileUrl"}).first()
    assert mapped.raw_profile_url == "https://tiktok.com/@ida" and mapped.raw_email is None


def test_own_aliases(spark):
    own = {"fullName": ["Artist"], "email": ["Post Box"]}
    assert M.suggested_mapping(spark, ["artist", "POST-BOX", "Full Name"], own) == {
        "artist": "fullName", "POST-BOX": "email"}


def test_file_routing(spark):
    files = spark.createDataFrame([("a.CSV",), ("b.xlsx",), ("c.xls",), ("d.txt",)], "file_name string")
    good, bad = S.route_files(files)
    assert [r.file_name for r in good.collect()] == ["a.CSV"]
    assert {r.file_name: r.file_type for r in bad.collect()} == {
        "b.xlsx": "xlsx", "c.xls": "xlsx", "d.txt": None}


def test_validate(spark, now):
    rows = spark.createDataFrame([("imp", 0), ("imp", 1)], "import_id string, row_index bigint")
    creators = new_creators(rows, now).withColumn(
        "confidence_score", F.when(F.col("row_index") == 1, 101))
    good, bad = validate(creators, RULES["creators"])
    assert good.count() == 1 and bad.first().violations == ["confidence_score: out of range"]
    _, bad = validate(spark.createDataFrame([("x",)], "status string"),
                      Rules(one_of={"status": ["success"]}))
    assert bad.first().violations == ["status: not allowed"]
    assert set(RULES) >= {"creators", "import_history", "identity_cache_keys", "export_history"}
    assert {f.name for f in IMPORT_HISTORY.fields} >= set(RULES["import_history"].required)


# --- streaming ------------------------------------------------------------------------------------


@pytest.fixture()
def batches(spark):
    def rows(import_id, emails):
        return conform(
            new_creators(spark.createDataFrame(
                [(import_id, i, e) for i, e in enumerate(emails)],
                "import_id string, row_index bigint, raw_email string")), CREATORS)

    return [rows("a", ["ida.doe@x.com", "tilda.roe@x.com"]),
            rows("b", ["ida.doe@x.com", "noor.poe@x.com"])]


def test_batches_share_the_cache_and_replay(spark, dictionary, batches, tmp_path):
    job = IncrementalEnrichment(spark, str(tmp_path / "state"), dictionary)
    for n, rows in enumerate(batches):
        job.run_batch(rows, n)

    def state():
        return sorted((r.batch_id, r.import_id, r.row_index, r.processing_status, r.identity_cache_id)
                      for r in job.table("creators").collect())

    first = state()
    assert [s[3] for s in first] == ["enriched", "enriched", "cache_hit", "enriched"]
    assert first[2][4] == first[0][4]
    job.run_batch(batches[1], 1)                    # a replay gives the same rows
    assert state() == first
    assert job.table("identity_cache").count() == 3
    assert job.table("identity_cache", before=1).count() == 2


def test_stream_of_files(spark, dictionary, batches, now, tmp_path):
    landing = str(tmp_path / "in")
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(landing)
    job = IncrementalEnrichment(spark, str(tmp_path / "state"), dictionary)
    stream = spark.readStream.schema(CREATORS).option("maxFilesPerTrigger", 1).parquet(landing)
    job.start(stream, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    rows = job.table("creators").collect()
    assert len(rows) == 4 and len({r.batch_id for r in rows}) == 2
    assert sum(r.processing_status == "cache_hit" for r in rows) == 1
    everything = enrich(batches[0].unionByName(batches[1]), dictionary, now=now)
    assert everything.new_identities.count() == job.table("identity_cache").count()


def plain_records(text, sep=","):
    """One character after another: records of cells, and whether the last one is closed."""
    out, record, cell, inside, i = [], [], "", False, 0

    def ends(at):
        rest = text[at:].lstrip(" ")
        return rest == "" or rest[0] in sep + "\n" or rest.startswith("\r\n")

    start = True
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell += '"'
                i += 1
            elif c == '"' and ends(i + 1):
                inside = False
                while text[i + 1 : i + 2] == " ":
                    i += 1
            else:
                cell += c
        elif c == '"' and start:
            inside, start = True, False
        elif c == sep:
            record.append(cell)
            cell, start = "", True
        elif c == "\n" or text.startswith("\r\n", i):
            i += c == "\r"
            if record or cell or not start:
                out.append([*record, cell])
            record, cell, start = [], "", True
        else:
            cell, start = cell + c, False
        i += 1
    if record or cell or not start:
        out.append([*record, cell])
    return out, not inside


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_that_span_lines_and_splits(spark, tmp_path, tiny_splits):
    rng = np.random.default_rng(6)
    pieces = ['"a', 'b"', "x", ",", ",", "\n", "\n", '""', '"', " ", "long text without end ", "\r\n",
              '"q, ""r"" \n s"', "\n\n", 'say "hi"', '",', ',"']
    for n in range(6):
        text = "h1,h2\n"
        while len(text) < 1500:
            text += "".join(rng.choice(pieces, 30))
        text += '"\n' if not plain_records(text)[1] else ""
        want, closed = plain_records(text)
        (tmp_path / f"{n}.csv").write_text(text, newline="")
        got = S.read_csv(spark, str(tmp_path / f"{n}.csv"))
        rows = got.rows.orderBy("block", "pos").collect()
        cells = [[*r.cells, *(r.surplus or [])] for r in rows]
        assert closed and cells == [w + [""] * (2 - len(w)) for w in want[1:]]
        assert got.rejects.count() == 0
        assert len({r.block for r in rows}) > 3


def test_line_breaks_are_kept_and_headers_may_hold_one(spark, now, tmp_path):
    text = '\r\n"first\nname";email\r\n"a\r\nb";"c\n\nd"\r\n\r\nx;\r\n'
    (tmp_path / "h.csv").write_text(text, newline="")
    got = S.read_csv(spark, str(tmp_path / "h.csv"))
    assert got.headers == ["first\nname", "email"]
    assert [r.cells for r in got.rows.orderBy("pos").collect()] == [["a\r\nb", "c\n\nd"], ["x", ""]]
    (tmp_path / "m.csv").write_text('a,b\r1,"x\ry"\r2,z\r', newline="")
    got = S.read_csv(spark, str(tmp_path / "m.csv"))
    assert [r.cells for r in got.rows.orderBy("pos").collect()] == [["1", "x\ry"], ["2", "z"]]


def test_long_cells_in_short_and_surplus_rows(spark, now, tmp_path):
    long = "x" * 100_000
    text = f'name,bio,email\nA,"{long}"\nB,"{long}",e,"{long}""{long}"\n'
    text += f'C,"{long}\n{long}",c@x\nD,{long}'
    _, rows = payloads(spark, now, tmp_path, text)
    assert [r["name"] for r in rows] == ["A", "B", "C", "D"]
    assert [len(r["bio"]) for r in rows] == [100_000, 100_000, 200_001, 100_000]
    assert len(rows[1][S.SURPLUS][0]) == 200_001 and rows[2]["email"] == "c@x"


def test_rejects(spark, now, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b'name,bio\nA,x\nB,"caf\xff"\n\nC,"never\nclosed\n,\n')
    (folder / "b.csv").write_bytes(b'name,bio\nD,"two\nlines"\n')
    got = S.read_csv(spark, str(folder))
    assert sorted(r.cells for r in got.rows.collect()) == [["A", "x"], ["B", "caf�"], ["D", "two\nlines"]]
    assert sorted((r.file[-5:], r.line, r.raw, r.reason, r.kept) for r in got.rejects.collect()) == [
        ("a.csv", 3, 'B,"caf�"', "bad_encoding", True), ("a.csv", 5, 'C,"never', "unclosed_quote", False),
        ("a.csv", 6, "closed", "unclosed_quote", False), ("a.csv", 7, ",", "unclosed_quote", False),
    ]
    limited = R.scan(spark, str(folder / "b.csv"), longest=8)
    assert limited.rows.count() == 0
    assert {(r.line, r.reason) for r in limited.rejects.collect()} == {
        (2, "record_too_long"), (3, "record_too_long")}


def test_one_file_is_read_by_many_tasks(spark, now, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200kb")
    lines = [f'{i},"note {i}\nline, ""two"" {"z" * (i % 90)}"\n' for i in range(30_000)]
    (tmp_path / "big.csv").write_text("n,note\n" + "".join(lines))
    got = S.ingest_csv(spark, str(tmp_path / "big.csv"), "imp", now)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = got.creators.select(
        "row_index", F.get_json_object("raw_payload", "$.n").cast("bigint").alias("n"),
        F.get_json_object("raw_payload", "$.note").alias("note")).collect()
    assert len(rows) == 30_000 and all(r.row_index == r.n for r in rows)
    assert all(r.note == f'note {r.n}\nline, "two" {"z" * (r.n % 90)}' for r in rows)


def test_usable_pages_with_a_frequent_url(spark):
    from personae.sources.pages import usable_pages

    schema = "url string, html string"
    static = spark.createDataFrame([("a", "x" * 50)] * 4 + [("b", "short")], schema)
    browser = spark.createDataFrame(
        [("a", f"y{k}") for k in range(6)] + [("b", f"z{k}") for k in range(6)] + [(None, "n")] * 3,
        schema)
    got = usable_pages(static, browser, min_length=20, hot_rows=2)
    assert sorted((str(r.url), r.html, r.fetched_via) for r in got.collect()) == sorted(
        [("a", "x" * 50, "static")] * 4 + [("b", f"z{k}", "browser") for k in range(6)]
        + [("None", "n", "browser")] * 3)
