from pathlib import Path

import pytest

from schedlake.operators import drift

DATA = Path("/root/testdata/sf0.01")
XER = "file_id bigint, seq_no int, table_name string, fields array<string>, cells array<array<string>>"


def revisions(spark, n, programme="p"):
    return spark.createDataFrame([(i, programme, i) for i in range(1, n + 1)], "file_id bigint, programme_id string, rev_no int")


def found(spark, exports, n=None):
    rows = [(f, 1, t, names, cells) for f, t, names, cells in exports]
    df = spark.createDataFrame(rows, XER)
    got = drift.changes(df, revisions(spark, n or max(r[0] for r in rows)))
    return {(r["file_id"], r["table_name"], r["change_kind"], r["field_name"]) for r in got.collect()}


def task(*rows):
    return [list(r) for r in rows]


def test_kinds_of_change(spark):
    a = (1, "TASK", ["task_id", "code", "old_name", "gone", "n"], task(["1", "A", "x", "q", "80"], ["2", "B", "y", "q", "90"], ["3", "C", "z", "q", ""]))
    b = (2, "TASK", ["N", "CODE", "new_name", "Task_ID", "fresh", "code"], task(["80 h", "A", "x", "1", "1", "?"], ["90 h", "B", "y", "2", "2", "?"], ["", "D", "w", "4", "3", "?"]))
    assert found(spark, [a, b]) == {(2, "TASK", "renamed", "old_name"), (2, "TASK", "removed", "gone"), (2, "TASK", "added", "fresh"), (2, "TASK", "retyped", "n")}


def test_writing_and_odd_cells_are_no_changes(spark):
    a = (1, "TASK", ["task_id", "n", "d", "f", "e"], task(["1", "80", "2025-01-01 08:00", "Y", ""], ["2", "90", "", "N", ""], ["3", "91", "", "N", ""]))
    b = (2, "TASK", ["task_id", "n", "d", "f", "e"], task(["1", "80.00", "2025-01-01 08:00", "N", "x"], ["2", "n/a", "", "N", "x"], ["3", "+9e1", "", "Y", "x"]))
    assert found(spark, [a, b]) == set()


def test_nearest_export_that_holds_the_table(spark):
    a = (1, "PROJECT", ["proj_id", "x"], [["1", "5"]])
    b = (2, "TASK", ["task_id"], [["1"]])
    c = (3, "PROJECT", ["proj_id", "y"], [["1", "5.0"]])
    again = (3, "PROJECT", ["proj_id", "y"], [["1", "5.0"]])
    assert found(spark, [a, b, c, again]) == {(3, "PROJECT", "renamed", "x")}


def test_many_revisions_of_one_programme(spark):
    # The nearest earlier export lies in another chunk of revision numbers.
    rows = [(i, "TASK", ["task_id", "a" if i < 600 else "b"], [["1", "x"]]) for i in (1, 2, 599, 600, 601, 1400)]
    assert found(spark, rows, 1400) == {(600, "TASK", "renamed", "a")}


#: Exports of several programmes, told apart by hundreds of file_id, so that one run serves all tests of the chain.
CHAINS = {
    "chained": [
        (1, 1, "TASK", ["task_id", "a"], [["1", "p"], ["2", "q"]]), (2, 1, "TASK", ["task_id", "b"], [["1", "p"], ["2", "q"]]),
        (3, 1, "TASK", ["c", "task_id", "extra"], [["p", "1", "7.0"], [" q ", "2", None]]),
    ],
    "anew": [
        (101, 1, "TASK", ["task_id", "a"], [["1", "p"], ["2", "q"]]), (102, 1, "TASK", ["task_id", "b"], [["1", "p"], ["2", "q"]]),
        (103, 1, "TASK", ["task_id", "b", "a"], [["1", "p", "new"], ["2", "q", "newer"]]), (104, 1, "TASK", ["task_id", "a"], [["1", "x"], ["2", "y"]]),
        (105, 1, "TASK", ["task_id", "a", "b"], [["1", "x", "back"], ["2", "y", "again"]]),
    ],
    "swap": [
        (200 + f, 1, "TASK", names, [["1", "p", "r"], ["2", "q", "s"]])
        for f, names in ((1, ["task_id", "a", "b"]), (2, ["task_id", "t", "b"]), (3, ["task_id", "t", "a"]), (4, ["task_id", "b", "a"]))
    ],
    "onto": [
        (301, 1, "TASK", ["task_id", "x"], [["1", "gone"], ["2", "too"]]), (302, 1, "TASK", ["task_id", "z"], [["1", "5"], ["2", "6"]]), (303, 1, "TASK", ["task_id", "x"], [["1", "5"], ["2", "6"]]),
    ],
    "cast": [
        (400 + f, 1, "TASK", ["task_id", "n", "d", "f", "code", "u"], cells)
        for f, cells in (
            (1, [["1", "67", "2025-11-09 17:00", "Y", "64", "5"], ["2", "58.50", "2025-01-30 07:30", "N", "77", "6"]]),
            (2, [["1", "67h", "1762707600", "1", "PR_FS", "5 hrs"], ["2", "58,5", "45687.3125", "0", "PR_SS", "odd one"]]),
            (3, [["1", "ID-67", "2025-11-09 17:00", "true", "PR_FS", "5"], ["2", "58.5", "", "false", "PR_SS", "7"]]),
        )
    ],
    "again": [
        (501, 1, "TASK", ["task_id", "a"], [["1", "p"]]), (501, 2, "TASK", ["a", "task_id", "z"], [["q", "2", "w"]]), (501, 1, "TASK", ["task_id", "a"], [["1", "p"]]),
        (502, 1, "TASK", ["task_id", "a", "z"], [["1", "p", "w"]]),
    ],
}


@pytest.fixture(scope="module")
def chained(spark):
    """Per programme: (file within it, seq_no, row_no) to (record, uncast); a file without a revision stands under None."""
    rows = [r for part in CHAINS.values() for r in part] + [(999, 1, "TASK", ["Task_ID", "b"], [["7", "80.0"]])]
    revs = [(f, name, f) for name, part in CHAINS.items() for f in {r[0] for r in part}]
    df = spark.createDataFrame(rows, XER).selectExpr("*", "1 AS row", "2 AS names", "'x' AS content")
    out = {}
    for r in drift.consistent_rows(df, spark.createDataFrame(revs, "file_id bigint, programme_id string, rev_no int")).collect():
        out.setdefault(r["programme_id"], {})[r["file_id"] % 100, r["seq_no"], r["row_no"]] = (r["record"], r["uncast"])
    return out


def test_chained_names_and_consistent_rows(spark, chained):
    out = chained["chained"]
    assert len(out) == 6 and all(set(r) == {"c", "extra", "task_id"} and not u for r, u in out.values())
    assert out[2, 1, 1][0] == {"c": "q", "extra": None, "task_id": "2"} and out[3, 1, 0][0]["extra"] == "7" and out[3, 1, 1][0]["c"] == "q"
    changed = drift.changes(spark.createDataFrame(CHAINS["chained"], XER), revisions(spark, 3))
    steps = {(r["file_id"], r["step_no"], r["step"], r["field_name"], r["target"]) for r in drift.migration_steps(changed).collect()}
    assert steps == {(2, 1, "rename", "a", "b"), (3, 1, "rename", "b", "c"), (3, 2, "default", "extra", None)}


def test_a_name_used_anew_is_another_field(chained):
    out = {k: r for k, (r, _) in chained["anew"].items()}
    assert out[1, 1, 0] == {"task_id": "1", "b": "p", "a": None} and out[3, 1, 0] == {"task_id": "1", "b": "p", "a": "new"}
    assert out[4, 1, 0] == {"task_id": "1", "b": None, "a": "x"} and out[5, 1, 1] == {"task_id": "2", "b": "again", "a": "y"}


def test_names_that_change_places_step_by_step(chained):
    out = {k: r for k, (r, _) in chained["swap"].items()}
    assert all(out[f, 1, 0] == {"task_id": "1", "b": "p", "a": "r"} and out[f, 1, 1] == {"task_id": "2", "b": "q", "a": "s"} for f in (1, 2, 3, 4))


def test_a_rename_onto_a_dropped_name_keeps_both(chained):
    out = {k: r for k, (r, _) in chained["onto"].items()}
    assert out[2, 1, 0]["x"] == out[3, 1, 0]["x"] == "5" and "gone" in out[1, 1, 0].values() and out[1, 1, 0]["x"] is None


def test_values_are_cast_to_the_final_type(chained):
    out = chained["cast"]
    first = {"task_id": "1", "n": "67", "d": "2025-11-09 17:00", "f": "Y", "u": "5"}
    for f in (1, 2, 3):
        assert {k: v for k, v in out[f, 1, 0][0].items() if k != "code"} == first
    assert out[2, 1, 1][0] | {"code": 0} == {"task_id": "2", "n": "58.5", "d": "2025-01-30 07:30", "f": "N", "u": None, "code": 0} and out[2, 1, 1][1] == {"u": "odd one"}
    assert out[1, 1, 0][0]["code"] == "64" and out[3, 1, 0][0]["code"] == "PR_FS" and not out[1, 1, 0][1]


def test_second_declarations_and_files_without_a_revision(chained):
    assert {k: r for k, (r, _) in chained["again"].items()} == {
        (1, 1, 0): {"task_id": "1", "a": "p", "z": None}, (1, 2, 0): {"task_id": "2", "a": "q", "z": "w"}, (2, 1, 0): {"task_id": "1", "a": "p", "z": "w"},
    }
    assert chained[None] == {(99, 1, 0): ({"task_id": "7", "b": "80"}, {})}


def test_versions_are_runs_of_one_fingerprint(spark):
    names = ["task_id", "n"]
    rows = [(1, 1, "TASK", names, [["1", "5"]]), (2, 1, "TASK", ["N", "task_id"], [["6.0", "1"]]), (3, 1, "TASK", names, [["1", "six"]]), (4, 1, "TASK", names, [["1", "5"]])]
    revs = spark.createDataFrame([(i, "p", i, v) for i, v in ((1, "8.3"), (2, "P6 8.3.0"), (3, None), (4, " 15.2"))], "file_id bigint, programme_id string, rev_no int, p6_version string")
    got = drift.versions(drift.paired_exports(spark.createDataFrame(rows, XER), revs)).collect()
    assert {(r["version_no"], r["file_id"], r["n_exports"], tuple(r["p6_versions"])) for r in got} == {(1, 1, 2, ("8.3",)), (2, 3, 1, ()), (3, 4, 1, ("15.2",))}
    assert len({r["fingerprint"] for r in got}) == 2


def test_nulls_and_empties(spark):
    rows = [(1, 1, "TASK", None, None), (1, 2, None, ["a"], None), (None, 1, "TASK", ["a"], [["1"]]), (2, 1, "TASK", ["a", None], [["1"], None, []]), (9, 1, "TASK", ["z"], [])]
    got = drift.changes(spark.createDataFrame(rows, XER), revisions(spark, 2)).collect()
    assert {(r["file_id"], r["change_kind"], r["field_name"]) for r in got} == {(2, "added", "a"), (2, "added", "")}
    assert drift.changes(spark.createDataFrame([], XER), revisions(spark, 1)).count() == 0


def plain_changes(exports):
    """The same rules said with dictionaries: exports are (programme, rev, file, table, fields, cells)."""
    import re

    number, stamp = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"), re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d")

    def kind(v):
        v = v.strip()
        return "number" if number.fullmatch(v) else "stamp" if stamp.fullmatch(v) else "flag" if v in ("Y", "N") else "text"

    said = lambda v: None if not (v or "").strip() else float(v) if number.fullmatch(v) else v.strip()
    out, before = set(), {}
    for prog, _, file, table, fields, cells in sorted(exports, key=lambda e: (e[0], e[3], e[1])):
        cols = {}
        for i, f in enumerate(fields):
            cols.setdefault(f.strip().lower(), [r[i] for r in cells])
        old = before.get((prog, table))
        before[prog, table] = cols
        if old is None:
            continue
        new_names, old_names = [n for n in cols if n not in old], [n for n in old if n not in cols]
        key = drift.ROW_KEYS[table]
        if key in cols and key in old:
            places = {said(k): i for i, k in enumerate(old[key])}
            met = [(i, places[said(k)]) for i, k in enumerate(cols[key]) if said(k) in places]
        else:
            met = [(i, i) for i in range(min(len(next(iter(cols.values()))), len(next(iter(old.values())))))]
        for n in list(new_names):
            for o in list(old_names):
                pairs = [(said(cols[n][i]), said(old[o][j])) for i, j in met]
                pairs = [p for p in pairs if p != (None, None)]
                if pairs and sum(a == b for a, b in pairs) / len(pairs) >= 0.8 and n in new_names:
                    out.add((file, table, "renamed", o))
                    new_names.remove(n)
                    old_names.remove(o)
        out |= {(file, table, "added", n) for n in new_names} | {(file, table, "removed", o) for o in old_names}
        for n in set(cols) & set(old):
            a, b = ([kind(v) for v in c[n] if v and v.strip()] for c in (old, cols))
            if a and b and max(set(b), key=b.count) != max(set(a), key=a.count) and 2 * sum(k != max(set(a), key=a.count) for k in b) > len(b):
                out.add((file, table, "retyped", n))
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stored_exports_match_plain_python(spark):
    xer, revs = spark.read.parquet(f"{DATA}/xer_table.parquet"), spark.read.parquet(f"{DATA}/revision.parquet")
    by = {r["file_id"]: (r["programme_id"], r["rev_no"]) for r in revs.collect()}
    rows = {(r["file_id"], r["table_name"]): r for r in sorted(xer.collect(), key=lambda r: -r["seq_no"])}
    want = plain_changes([(*by[f], f, t, r["fields"], r["cells"]) for (f, t), r in rows.items()])
    got = {(r["file_id"], r["table_name"], r["change_kind"], r["field_name"]) for r in drift.changes(xer, revs).collect()}
    assert got == want and len(want) > 30
