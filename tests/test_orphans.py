import random
from datetime import datetime

from schedlake.operators.orphans import Reference, Table, direct_orphans, orphan_cascade
from schedlake.operators.skew import hot_keys, lookup


def day(n):
    return datetime(2025, 1, n)


def tables(spark):
    task = [("1", "c1", day(2), None), ("1", "c1", day(9), None), ("2", " c9 ", day(2), None), ("3", " ", day(2), None), ("4", "c9", day(2), day(3)), ("5", "c2", day(2), None), ("6", "c3", day(2), None), (None, "c9", day(2), None)]
    cal = [("c1", day(1), None), ("c2", day(1), day(2)), ("c2", day(1), None), ("c3", day(5), None), ("c3", day(6), None), (None, day(1), None)]
    pred = [(11, "2", day(4)), (12, "1", day(4)), (13, None, day(4)), (14, "77", day(4)), (14, "77", day(4)), (15, "4", datetime(2025, 2, 1))]
    return {
        "task": Table("task", spark.createDataFrame(task, "id string, cal string, loaded_at timestamp_ntz, deleted_at timestamp_ntz").selectExpr("*", "1 AS key", "2 AS fk"), "id", deleted_refers=False),
        "cal": Table("cal", spark.createDataFrame(cal, "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"), "id"),
        "pred": Table("pred", spark.createDataFrame(pred, "id bigint, of string, loaded_at timestamp_ntz"), "id", deleted_at=None),
    }


REFS = [Reference("task", "cal", "cal"), Reference("pred", "of", "task")]


def test_direct_reasons(spark):
    got = {(r["table_name"], r["record_key"], r["reason"], r["period"]) for r in direct_orphans(tables(spark), REFS).collect()}
    assert got == {
        ("task", "2", "missing", "2025-01"), ("task", "5", "deleted", "2025-01"), ("task", "6", "late", "2025-01"), ("pred", "14", "missing", "2025-01"),
        ("pred", "15", "deleted", "2025-02"),
    }


def test_cascade_runs_down(spark):
    got = {(r["table_name"], r["record_key"]): r["level"] for r in orphan_cascade(tables(spark), REFS).collect()}
    assert got == {("task", "2"): 0, ("task", "5"): 0, ("task", "6"): 0, ("pred", "14"): 0, ("pred", "15"): 0, ("pred", "11"): 1}


def test_self_references_reach_a_fixpoint(spark):
    rows = [(str(i), str(i - 1) if i else "gone", day(1)) for i in range(5)] + [("8", "9", day(1)), ("9", "8", day(1)), ("7", "3", day(1))]
    t = {"n": Table("n", spark.createDataFrame(rows, "id string, up string, loaded_at timestamp_ntz"), "id", deleted_at=None)}
    got = {r["record_key"]: r["level"] for r in orphan_cascade(t, [Reference("n", "up", "n")]).collect()}
    assert got == {"0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "7": 4}


def test_levels_match_brute_force_over_a_graph_with_loops(spark):
    rnd = random.Random(6)
    names = ("a", "b", "c")
    rows = {t: [(f"{t}{i}", rnd.choice([None, f"{rnd.choice('bc')}{rnd.randrange(30)}", f"x{i}"]), rnd.choice([None, f"{t}{max(i - 1, 0)}" if i % 20 else None, f"{t}{i - 1}"]), day(1)) for i in range(25)] for t in names}
    refs = [Reference(t, "up", p) for t, p in (("a", "b"), ("b", "c"), ("c", "b"))] + [Reference(t, "own", t) for t in names]
    tables_ = {t: Table(t, spark.createDataFrame(v, "id string, up string, own string, loaded_at timestamp_ntz"), "id", deleted_at=None) for t, v in rows.items()}
    keys = {t: {r[0] for r in v} for t, v in rows.items()}
    links = [(r.child, row[0], r.parent, row[1] if r.field == "up" else row[2]) for r in refs for row in rows[r.child]]
    level = {(c, k): 0 for c, k, p, fk in links if fk is not None and fk not in keys[p]}
    for n in range(1, 200):
        level |= {(c, k): n for c, k, p, fk in links if (c, k) not in level and level.get((p, fk)) == n - 1}
    got = {}
    for r in orphan_cascade(tables_, refs).collect():
        got.setdefault((r["table_name"], r["record_key"]), r["level"])
    assert got == level and max(level.values()) > 3


def test_empty_tables(spark):
    t = {k: Table(v.name, v.rows.limit(0), v.key, deleted_at=v.deleted_at) for k, v in tables(spark).items()}
    assert orphan_cascade(t, REFS).count() == 0


def test_hot_keys_are_looked_up_apart(spark):
    facts = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 7, id) AS k").unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS BIGINT) AS k"))
    assert 7 in hot_keys(facts, "k", 0.1, 50) and len(hot_keys(facts, "k", 0.1, 50)) <= 10 and hot_keys(facts, "k") == []
    names = spark.range(500).selectExpr("id AS t", "id * 10 AS v")
    plain = lookup(facts, "k", names, "t", hot=[]).collect()
    split = lookup(facts, "k", names, "t", hot=[7]).collect()
    assert sorted(map(str, plain)) == sorted(map(str, split)) and len(split) == 1001
