from datetime import datetime

from schedlake.operators import rejects

LINE, LOG = "line_id bigint, file_id bigint, line_no int, line string", "log_id bigint, logged_at timestamp_ntz, raw string"


def reasons(spark, text, chunk=None):
    rows = [(i, 1, i, line) for i, line in enumerate(text, 1)]
    return {r["line_id"]: r["reason"] for r in rejects.rejected_rows(spark.createDataFrame(rows, LINE)).collect()}


def test_first_reason_holds(spark):
    text = [
        "ERMHDR\t8.3", "%R\tlost", "%T\tTASK\r", "%R\tearly", "%F\ttask_id\tx_cnt\ty_date\r", "%R\t1\t80.00\t2025-01-01 08:00\r", "%R\t1\t2", "%R\tA\t1\t", "%R\t 2 \t1,5\t",
        "%R\t3\t \t2025-02-30", "%R\t4\0\tx\t", "%R\t5\t1", "more\t2025-01-01", "%Reinforced", "%R\t6\t1\t", "%T\tZZ", "%F", "%R", "%R\tone", "%R\ta\tb", "%E", "tail",
    ]
    assert reasons(spark, text) == {
        2: "no_fields", 4: "no_fields", 7: "column_count", 8: "bad_key", 9: "bad_value", 10: "bad_value", 11: "nul", 12: "bad_value", 20: "column_count"
    }


def test_sound_rows_come_out_whole(spark):
    text = ["%T\tTASK", "%F\ttask_id\ttask_name", "%R\t1\tlong", "name", "%R\t2\tshort", "%R\tx\tbad"]
    rows = [(i, 1, i, line) for i, line in enumerate(text, 1)]
    df = spark.createDataFrame(rows, LINE).selectExpr("*", "'x' AS marker", "1 AS cells", "2 AS reason")
    got = {r["line_id"]: r["cells"] for r in rejects.load_rows(df).collect()}
    assert got == {3: ["1", "long\nname"], 5: ["2", "short"]}
    assert {r["line_id"] for r in rejects.rejected_rows(df).collect()} == {6}


def test_carried_over_chunks_and_files(spark):
    # The field list stands thousands of lines before the row it governs; a second file has none.
    rows = [(1, 1, 1, "%T\tTASK"), (2, 1, 2, "%F\ttask_id\tn")] + [(n, 1, n, f"%R\t{n}\tx") for n in range(3, 9000)] + [(9001, 1, 9001, "%R\t1")]
    rows += [(9100, 2, 1, "%R\t1\tx"), (9101, 2, None, "%R\t1\tx"), (9102, None, 3, "%R"), (9103, 2, 9, None)]
    got = {r["line_id"]: r["reason"] for r in rejects.rejected_rows(spark.createDataFrame(rows, LINE)).collect()}
    assert got == {9001: "column_count", 9100: "no_fields"}


GOOD = "7,2025-01-01T10:00:00,10,{},8.3,true,true,0,0,10,true,,5".format("a" * 64)


def test_scans(spark):
    rows = {
        1: GOOD, 2: ",".join(rejects.SCAN_COLUMNS), 3: GOOD.replace(",,5", ',"a, ""b""",5'), 4: GOOD.replace(",,5", ',"open,5'), 5: GOOD.replace(",,5", ',"a"b,5'),
        6: GOOD + ",", 7: GOOD.replace("7,2025", "0,2025"), 8: GOOD.replace("01-01T", "02-30T"), 9: GOOD.replace(",0,0,10,", ",11,0,10,"), 10: GOOD.replace("true,,", "True,,"),
        11: GOOD.replace("a" * 64, "a" * 63), 15: GOOD[1:], 16: GOOD[1:].replace(",,5", ',"a, ""b""",5'), 17: "," * 12, 18: '""' + GOOD[1:], 12: None, 13: '"' * 200_000, 14: GOOD.replace(",10,a", ",99999999999999999999999,a"),
    }
    df = spark.createDataFrame([(k, datetime(2025, 1, 1), v) for k, v in rows.items()], LOG)
    got = {r["log_id"]: r["reason"] for r in rejects.rejected_scans(df).collect()}
    assert got == {
        4: "broken_quote", 5: "broken_quote", 6: "column_count", 7: "bad_key", 8: "bad_value", 9: "bad_value", 10: "bad_value", 11: "bad_value", 12: "column_count", 13: "column_count",
        15: "bad_key", 16: "bad_key", 17: "bad_key", 18: "bad_key",
    }
    loaded = {r["log_id"]: r for r in rejects.load_scans(df).collect()}
    assert set(loaded) == {1, 3, 14} and loaded[3]["tokenizer_detail"] == 'a, "b"' and loaded[1]["file_id"] == 7


def test_empty_tables(spark):
    assert rejects.found(spark.createDataFrame([], LINE), spark.createDataFrame([], LOG)).count() == 0
