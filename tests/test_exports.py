import gzip
import json

from schedlake.operators import documents, rejects
from schedlake.sources import exports
from schedlake.streaming import jobs

BODY = "\r\n".join([
    "ERMHDR\t8.3\t2025-01-01\tProject\tme\tMe\tdb\tPM\tEUR", "%T\tPROJECT", "%F\tproj_id", "%R\t1", "%T\tTASK", "%F\ttask_id\ttask_name\ttarget_drtn_hr_cnt\ttask_name",
    "%R\t7\tcafé – 5€\t80.0\tlast", "%R\t8\ttwo", "lines\t\tx", "%R\tx\tbad\t1\t", "%E", "",
])


def write(folder, name, data):
    (folder / name).write_bytes(data)


def test_files_to_typed_tables(spark, tmp_path):
    write(tmp_path, "a.xer", BODY.encode("cp1252"))
    write(tmp_path, "b.xer", gzip.compress(BODY.encode("cp1252")))
    write(tmp_path, "c.xer", b"\0" * 9)
    write(tmp_path, "d.xer", b"")
    files = exports.read_files(spark, str(tmp_path))
    lines = exports.file_lines(files)
    rows = exports.typed_table(rejects.load_rows(lines), "TASK").collect()
    assert sorted((r["task_id"], r["task_name"], r["target_drtn_hr_cnt"], r["wbs_id"]) for r in rows) == sorted([(7, "café – 5€", 80.0, None), (8, "two\nlines", None, None)] * 2)
    assert {r["currency"] for r in exports.headers(lines).collect()} == {"EUR"}
    facts = {r["file_id"][-5:]: r for r in exports.scan(files).collect()}
    assert facts["a.xer"]["reaches_end_marker"] and facts["a.xer"]["content_hash"] == facts["b.xer"]["content_hash"]
    assert (facts["c.xer"]["nul_byte_count"], facts["c.xer"]["trailing_nul_run"], facts["c.xer"]["complete_bytes"]) == (9, 9, 0)
    assert facts["a.xer"]["high_byte_count"] == 3 and "d.xer" not in facts


def test_gunzip(spark):
    pack = lambda *parts: bytearray(b"".join(gzip.compress(p) for p in parts))
    rows = [("big", pack(b"x" * 1000)), ("null", None), ("plain", bytearray(b"plain")), ("two", pack(b"a" * 500, b"b" * 400)), ("two big", pack(b"a" * 500, b"b" * 500)), ("cut", pack(b"x" * 900)[:-9]), ("pad", pack(b"ok") + b"\0\0"), ("junk", pack(b"ok") + b"junk")]
    got = {r["file_id"]: (r["content"], r["refused"]) for r in exports.unpacked(spark.createDataFrame(rows, "file_id string, content binary"), 999).collect()}
    assert got == {
        "big": (None, "byte_cap"), "null": (None, None), "plain": (bytearray(b"plain"), None), "two": (bytearray(b"a" * 500 + b"b" * 400), None), "two big": (None, "byte_cap"),
        "cut": (None, "broken_gzip"), "pad": (bytearray(b"ok"), None), "junk": (None, "broken_gzip"),
    }


def test_verdict_order(spark):
    base = {"bytes": 10, "reaches_end_marker": True, "nul_byte_count": 0, "starts_with_ermhdr": True, "tokenizer_ok": True, "activity_count": 5, "project_count": 1}
    cases = [
        ({}, "accept"), ({"bytes": exports.READ_CAP + 1, "nul_byte_count": 1}, "oversize"), ({"nul_byte_count": 1, "starts_with_ermhdr": False}, "unreadable"),
        ({"starts_with_ermhdr": False, "tokenizer_ok": False}, "not_xer"), ({"tokenizer_ok": False, "activity_count": 0}, "tokenizer"), ({"activity_count": 0}, "no_activities"),
        ({"project_count": 2, "activity_count": 20_001}, "multi_project"), ({"activity_count": 20_001}, "activity_cap"), ({"bytes": exports.BYTE_CAP + 1}, "byte_cap"),
    ]
    rows = [tuple((base | c).values()) + (want,) for c, want in cases]
    df = spark.createDataFrame(rows, "bytes bigint, reaches_end_marker boolean, nul_byte_count int, starts_with_ermhdr boolean, tokenizer_ok boolean, activity_count int, project_count int, want string")
    assert exports.verdict(df).where("verdict <> want").count() == 0


def test_documents(spark, tmp_path):
    one = lambda **kw: spark.createDataFrame([("p", *kw.values())], "proj_id string, " + ", ".join(f"{k} int" for k in kw))
    worst = spark.range(40_000).selectExpr("'p' AS proj_id", "1 AS check_no", "CAST(id AS INT) AS place", "id AS task_id", "1D AS badness")
    groups = lambda c: {"shape": one(a=1), "progress": one(b=2), "time": c, "quality": one(d=4)}
    small = documents.derived(groups(one(c=3)), {"exemplars": worst.limit(2)}).first()
    assert json.loads(small["document"])["lists"]["exemplars"][0]["task_id"] == 0 and not small["over_warn"]
    big = documents.derived(groups(one(c=3).limit(0)), {"exemplars": worst}).first()
    doc = json.loads(big["document"])
    assert "lists" not in doc and len(doc["issues"]) == 2 and len(big["document"]) < documents.MAX_BYTES
    documents.write_documents(spark.createDataFrame([small]), str(tmp_path / "out"))
    documents.write_documents(spark.createDataFrame([small]), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, documents.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, documents.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_streams(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write(source, "a.xer", BODY.encode("cp1252"))
    write(source, "z.xer", gzip.compress(BODY.encode("cp1252"))[:-20])
    for _ in range(2):
        jobs.ingest(spark, str(source), str(target), str(tmp_path / "cp")).awaitTermination()
    write(source, "b.xer", gzip.compress(BODY.encode("cp1252")))
    jobs.ingest(spark, str(source), str(target), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(target / "rows")).count() == 6 and spark.read.parquet(str(target / "scan")).count() == 2
    refused = {(r["file_id"][-5:], r["reason"], (r["line_id"] or "")[-10:]) for r in spark.read.parquet(str(target / "refused")).collect()}
    assert refused == {("z.xer", "broken_gzip", ""), ("a.xer", "bad_key", "0000000010"), ("b.xer", "bad_key", "0000000010")}
    spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2D AS value UNION ALL SELECT TIMESTAMP_NTZ '2024-01-01 00:50:00', 'a', 3D").write.parquet(str(tmp_path / "ev"))
    events = jobs.file_stream(spark, str(tmp_path / "ev"), "ts timestamp_ntz, event_type string, value double")
    query = jobs.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT n, value FROM counts").collect()] == [(2, 5.0)]


def test_byte_facts_count_task_and_wbs_names(spark, tmp_path):
    from schedlake.plans.exports import s1_decode_report

    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(1, 5, "caf\u00e9"), (1, 5, "caf\u00e9"), (1, 6, None)], "file_id bigint, task_id bigint, task_name string", "task")
    save([("p", 1), ("p", 1), ("q", 2), ("r", None)], "proj_id string, file_id bigint", "project")
    save([(5, "p", "\u00e9\u00e9"), (8, "q", "\u00e9"), (9, "r", "\u00e9"), (10, None, "\u00e9")], "wbs_id bigint, proj_id string, wbs_name string", "projwbs")
    assert {r["file_id"]: r["high_byte_count"] for r in s1_decode_report(spark, str(tmp_path)).collect()} == {1: 3, 2: 1}
