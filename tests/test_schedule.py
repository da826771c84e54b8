import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from schedlake.operators import calendars, cpm, driving, quality, stats

WEEK = "".join(f"(0||{d}()({'' if d in (1, 7) else '(0||0(s|08:00|f|12:00)())(0||1(s|13:00|f|17:00)())'}))" for d in range(1, 8))
PACKED = f"(0||CalendarData()((0||DaysOfWeek()({WEEK}))(0||Exceptions()((0||0(d|45659)())(0||1(d|45661)((0||0(s|08:00|f|12:00)()))))))"


def test_calendar_is_decoded():
    got = calendars.decode(PACKED + ")")
    assert got["state"] == "ok", got
    assert got["working_days_per_week"] == 5 and got["hours_per_week"] == 40 and got["hours_per_working_day"] == 8
    assert [(e["serial"], e["works"], e["hours"]) for e in got["exceptions"]] == [(45659, False, 0), (45661, True, 4)]


def test_layout_and_order_do_not_matter():
    plain = calendars.decode(PACKED + ")")
    noisy = calendars.decode((PACKED + ")").replace("(0||", "\x7f\r\n  (0||").replace("s|08:00|f|12:00", "f|12:00|s|8:00"))
    wrapped = calendars.decode(f"(0||Root()({PACKED})))".replace(")))))))", ")))))))"))
    assert noisy["meaning"] == plain["meaning"] and wrapped["meaning"] == plain["meaning"]
    twelve = calendars.decode((PACKED + ")").replace("13:00", "1:00 PM").replace("17:00", "5:00 PM"))
    assert twelve["meaning"] == plain["meaning"]


@pytest.mark.parametrize("text", [None, "", "(", "nonsense", "(0||CalendarData()())", PACKED[:-9], (PACKED + ")").replace("17:00", "29:00"), (PACKED + ")").replace("f|17:00", "f|12:00"), (PACKED + ")").replace("0||7(", "0||6("), "(" * 50_000])
def test_broken_calendars_are_errors(text):
    assert calendars.decode(text)["state"] == "error"


def test_empty_slots_and_midnight():
    got = calendars.decode((PACKED + ")").replace("(0||1(s|13:00|f|17:00)())", "(0||1()())(0||2(s|13:00|f|00:00)())"))
    assert got["state"] == "ok" and got["hours_per_working_day"] == 15


def works(cal, day):
    by = {e["serial"]: e["works"] for e in cal["exceptions"]}
    serial = (day - dt.date(1899, 12, 30)).days
    return by.get(serial, {d["day"]: d["works"] for d in cal["week"]}[day.isoweekday() % 7 + 1])


def test_working_days_match_counting(spark):
    cal = calendars.decode(PACKED + ")")
    rnd = random.Random(1)
    spans = [(i, dt.date(2024, 12, 1) + dt.timedelta(rnd.randrange(90)), rnd.randrange(-3, 60)) for i in range(60)]
    rows = [(i, a, a + dt.timedelta(n), PACKED + ")") for i, a, n in spans] + [(99, None, dt.date(2025, 1, 1), PACKED + ")")]
    df = spark.createDataFrame(rows, "i int, a date, b date, clndr_data string").withColumn("d", calendars.decode_calendar(F.col("clndr_data")))
    got = {r["i"]: r["n"] for r in df.select("i", calendars.working_days(F.col("d.week"), F.col("d.exceptions"), F.col("a"), F.col("b")).alias("n")).collect()}
    for i, a, b, _ in rows[:-1]:
        want = sum(works(cal, a + dt.timedelta(k)) for k in range((b - a).days + 1)) if b >= a else None
        assert got[i] == want, (a, b)
    assert got[99] is None


def test_instants():
    cal = calendars.decode(PACKED + ")")
    monday = dt.date(2025, 1, 6)
    assert calendars.instant_at(cal, monday, 4, False) == dt.datetime(2025, 1, 6, 13)
    assert calendars.instant_at(cal, monday, 4, True) == dt.datetime(2025, 1, 6, 12)
    assert calendars.instant_at(cal, monday, 41, True) == dt.datetime(2025, 1, 13, 9)
    assert calendars.instant_at(cal, monday, 0, True) is None


def test_cpm_invariants():
    rnd = random.Random(3)
    tasks = [(i, float(rnd.randrange(0, 40))) for i in range(80)]
    links = [(a, b, rnd.choice(["PR_FS", "PR_SS", "PR_FF", "PR_SF"]), float(rnd.randrange(-4, 9))) for b in range(1, 80) for a in rnd.sample(range(b), min(b, 2))]
    times = cpm.network_times(tasks, links)
    assert len(times) == 80
    for es, ef, ls, lf, total, free in times.values():
        assert es >= 0 and ef >= es and abs((ls - es) - total) < 1e-9 and 0 <= free and lf - ls == ef - es
    loop = cpm.network_times([(1, 1.0), (2, 1.0), (3, 2.0)], [(1, 2, "PR_FS", 0.0), (2, 1, "PR_FS", 0.0)])
    assert set(loop) == {3}
    chain = cpm.network_times([(1, 8.0), (2, 8.0), (3, 4.0)], [(1, 2, "PR_FS", 0.0), (1, 3, "PR_FS", 0.0)])
    assert chain[3][4] == 4 and chain[2][4] == 0
    assert cpm.critical_chains(chain, [(1, 2, "PR_FS", 0.0), (1, 3, "PR_FS", 0.0)])[0] == [1, 2]


def test_cpm_of_giant_groups_is_the_same(spark):
    rnd = random.Random(8)
    tasks = [(k, 100 * g + i, rnd.choice([None, *map(float, range(30))])) for g, k in enumerate("abc") for i in range(30 - 12 * g)]
    ids = {k: [t for g, t, _ in tasks if g == k] for k in "abc"}
    links = [(k, rnd.choice(ids[k][:i]), ids[k][i], rnd.choice(["PR_FS", "PR_SS", "PR_FF", "PR_SF", None]), rnd.choice([None, -4.0, 0.0, 7.5])) for k in "abc" for i in range(1, len(ids[k])) for _ in range(2)]
    links += [("a", 25, 24, "PR_FS", 0.0), ("a", 24, 25, "PR_FS", 0.0), ("a", 3, 3, "PR_FS", 1.0), ("b", 1, 101, "PR_FS", 9.0)]
    t = spark.createDataFrame(tasks, "key string, task_id bigint, hours double")
    e = spark.createDataFrame(links, "key string, pred_id bigint, succ_id bigint, pred_type string, lag_hr_cnt double")
    rows = lambda cap: sorted(map(tuple, cpm.schedule(t, e, cap).collect()))
    want = rows(1000)
    assert {r[0] for r in want} == set("abc") and 24 not in {r[1] for r in want}
    assert rows(10) == want and rows(1) == want


TASK = "proj_id string, task_id bigint, task_type string, status_code string, early_start_date string, early_end_date string, driving_path_flag string"
LINK = "succ_id bigint, pred_id bigint, pred_type string, lag_hr_cnt double"


def network(spark):
    d = lambda n, h: f"2025-01-{n:02d} {h:02d}:00"
    tasks = [
        ("p", 1, "TT_Task", "TK_Active", d(1, 8), d(2, 17), "Y"), ("p", 2, "TT_Task", "TK_NotStart", d(3, 8), d(4, 17), "N"), ("p", 3, "TT_Task", "TK_NotStart", d(2, 8), d(2, 17), None),
        ("p", 4, "TT_Task", "TK_NotStart", d(5, 8), d(6, 17), "Y"), ("p", 5, "TT_Task", "TK_Complete", d(5, 8), d(9, 17), "N"), ("q", 6, "TT_Task", "TK_Complete", d(1, 8), d(1, 9), "N"),
        ("r", 7, "TT_Task", "TK_NotStart", None, None, "N"), ("s", 8, "TT_Task", "TK_Active", d(1, 8), d(3, 8), "N"), ("s", 9, "TT_Task", "TK_Active", d(1, 8), d(3, 8), "N"),
    ]
    links = [(2, 1, "PR_FS", None), (2, 3, "PR_FS", 0.0), (4, 2, "PR_FS", 0.0), (4, 2, "PR_FS", 0.0), (4, 5, "PR_FS", 0.0), (4, 99, "PR_FS", 0.0), (9, 8, "PR_FF", 0.0), (8, 9, "PR_FF", 0.0)]
    return spark.createDataFrame(tasks, TASK), spark.createDataFrame(links, LINK)


def test_driving_path(spark):
    tasks, links = network(spark)
    drives = {(r["succ_id"], r["pred_id"]) for r in driving.driving_links(tasks, links).collect()}
    assert drives == {(2, 1), (2, 3), (4, 2), (9, 8), (8, 9)}
    local = driving.walk(tasks, links, "proj_id")
    members = {(r["proj_id"], r["task_id"]) for r in local.collect()}
    assert members == {("p", 4), ("p", 2), ("p", 1), ("p", 3), ("s", 8), ("s", 9)}
    assert {(r["proj_id"], r["task_id"]) for r in driving.walk(tasks, links, "proj_id", local_limit=2).collect()} == members
    summary = {r["proj_id"]: r for r in driving.path_summary(tasks, local, "proj_id").collect()}
    assert {k: r["state"] for k, r in summary.items()} == {"p": "ok", "q": "skip", "r": "unavailable", "s": "error"}
    assert summary["p"]["n_members"] == 4 and summary["p"]["share_pct"] == 100.0 and summary["s"]["cycle_count"] == 1 and summary["p"]["n_agreed"] == 2


def test_giant_driving_paths_are_the_same(spark):
    tasks, links = network(spark)
    d = "2025-01-03 08:00"
    more = [("u", i, "TT_Task", "TK_NotStart", "2025-01-01 08:00", "2025-01-02 17:00" if i < 13 else d, "N") for i in range(10, 14)]
    # u: 13 is driven by 12, which drives itself by way of 11; 10 drives 11 with it. Task 4 of p is driven by u's 11 too, which is where p's path ends.
    extra = [(13, 12, "PR_SS", 0.0), (12, 11, "PR_SS", 0.0), (11, 12, "PR_SS", 0.0), (11, 10, "PR_SS", 0.0), (1, 11, "PR_FS", 0.0)]
    tasks, links = tasks.unionByName(spark.createDataFrame(more, TASK)), links.unionByName(spark.createDataFrame(extra, LINK))
    rows = lambda limit: sorted(map(tuple, driving.walk(tasks, links, "proj_id", local_limit=limit).collect()))
    want = rows(1000)
    assert {("p", 11), ("u", 10), ("u", 11), ("u", 12)} <= {r[:2] for r in want} and ("p", 12) not in {r[:2] for r in want} and sum(r[2] for r in want) == 2
    loops = lambda got: {k: sum(r[2] for r in got if r[0] == k) for k in "psu"}
    for limit in (0, 3):
        got = rows(limit)
        assert [r[:2] for r in got] == [r[:2] for r in want] and loops(got) == loops(want)
    state = lambda limit: {r["proj_id"]: r["state"] for r in driving.path_summary(tasks, driving.walk(tasks, links, "proj_id", local_limit=limit), "proj_id").collect()}
    assert state(0) == state(1000) and state(0)["s"] == state(0)["u"] == "error" and state(0)["p"] == "ok"


def test_float_mix_sums_to_a_hundred(spark):
    rows = [("a", -1.0), ("a", 1.0), ("a", 400.0), ("b", None), ("c", 0.0), ("c", None), ("c", 352.0), ("c", 352.5)]
    got = {r["k"]: (r["neg_pct"], r["ok_pct"], r["high_pct"]) for r in stats.float_mix(spark.createDataFrame(rows, "k string, h double"), ["k"], "h", 352.0).collect()}
    assert got == {"a": (34, 33, 33), "b": (0, 0, 0), "c": (0, 67, 33)}


def test_buckets(spark):
    rows = [(-21.0, 0), (-20.0, 1), (-0.5, 1), (0.0, 2), (200.0, 8), (None, None)]
    df = spark.createDataFrame(rows, "x double, b int")
    assert df.where(~stats.bucket(F.col("x"), stats.FLOAT_EDGES).eqNullSafe(F.col("b"))).count() == 0
    low = spark.createDataFrame([(-5.0,)], "x double").select(stats.bucket(F.col("x"), stats.DURATION_EDGES)).first()[0]
    assert low == 0


def test_exemplars_are_capped_and_stable(spark):
    flags = "false AS no_pred, false AS no_succ, false AS hard, true AS high_float, false AS neg_float, false AS high_duration, CAST(NULL AS STRING) AS invalid, 1D AS target_drtn_hr_cnt"
    df = spark.range(200).selectExpr("'p' AS proj_id", "id AS task_id", "IF(id < 100, 400D, 500D) AS total_float_hr_cnt", *flags.split(", "))
    got = [(r["task_id"], r["place"]) for r in quality.exemplars(df).orderBy("place").collect()]
    assert got == [(100 + i, i + 1) for i in range(50)]
