"""Reference operators over the schedule tables: mixes, spans, histograms, curves, quality, paths.

The groups are projects. Every query has its SQL twin; what SQL cannot say has tests instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.dates import day_number, minute_number, real_day
from schedlake.functions.numbers import percent
from schedlake.operators import calendars, cpm, driving, hierarchy, quality, stats
from schedlake.session import store
from schedlake.sources.tables import table

# ---------------------------------------------------------------- views


def tasks_now(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each task that is not deleted."""
    return hierarchy.latest_rows(table(spark, folder, "task"), "task_id", "loaded_at", "deleted_at").where("deleted_at IS NULL")


def links_now(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each relationship: (proj_id, succ_id, pred_id, pred_type, lag_hr_cnt, pred_proj_id)."""
    rows = hierarchy.latest_rows(table(spark, folder, "taskpred"), "task_pred_id", "loaded_at")
    return rows.select("task_pred_id", "proj_id", F.col("task_id").alias("succ_id"), F.col("pred_task_id").alias("pred_id"), "pred_type", "lag_hr_cnt", "pred_proj_id")


def data_days(spark: SparkSession, folder: str) -> DataFrame:
    """(proj_id, data_day) from the latest row of each project."""
    rows = hierarchy.latest_rows(table(spark, folder, "project"), "proj_id", "loaded_at")
    return rows.select("proj_id", real_day(F.col("last_recalc_date")).alias("data_day")).where("data_day IS NOT NULL")


def data_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """(proj_id, minutes) of the data date in the latest row of each project."""
    rows = hierarchy.latest_rows(table(spark, folder, "project"), "proj_id", "loaded_at")
    return rows.select("proj_id", minute_number(F.col("last_recalc_date")).alias("minutes")).where("minutes IS NOT NULL")


def calendars_now(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each calendar that is not deleted, decoded."""
    rows = hierarchy.latest_rows(table(spark, folder, "calendar"), "clndr_id", "loaded_at", "deleted_at").where("deleted_at IS NULL")
    return rows.withColumn("d", calendars.decode_calendar(F.col("clndr_data"))).select("clndr_id", "clndr_name", "d.*")


def project_calendars(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of each project with tasks, its day's length, or why there is none."""
    projects = hierarchy.latest_rows(table(spark, folder, "project"), "proj_id", "loaded_at", "deleted_at").where("deleted_at IS NULL")
    return calendars.programme_calendars(tasks_now(spark, folder), projects, calendars_now(spark, folder))


def tasks_in_days(spark: SparkSession, folder: str) -> DataFrame:
    """``tasks_now`` with the hours of a day of each task's project."""
    days = project_calendars(spark, folder).select("proj_id", "hours_per_day")
    return tasks_now(spark, folder).join(days, "proj_id", "left").withColumn("hours_per_day", F.coalesce("hours_per_day", F.lit(calendars.FALLBACK_HOURS)))


TASKS_SQL = """task_now AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY loaded_at DESC) AS rn FROM task
    WHERE task_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL)"""
LINKS_SQL = """link_now AS (SELECT task_pred_id, proj_id, task_id AS succ_id, pred_task_id AS pred_id, pred_type, lag_hr_cnt, pred_proj_id
    FROM (SELECT *, row_number() OVER (PARTITION BY task_pred_id ORDER BY loaded_at DESC) AS rn FROM taskpred WHERE task_pred_id IS NOT NULL) WHERE rn = 1)"""
DAYS_SQL = """day_now AS (SELECT proj_id, try_cast(left(last_recalc_date, 10) AS DATE) AS data_day
    FROM (SELECT *, row_number() OVER (PARTITION BY proj_id ORDER BY loaded_at DESC) AS rn FROM project) WHERE rn = 1 AND try_cast(left(last_recalc_date, 10) AS DATE) IS NOT NULL)"""
#: The hours of a day of each project's calendar, where all its working days are alike; 8 without one. Follows TASKS_SQL.
CAL_SQL = r"""cal_now AS (SELECT CAST(clndr_id AS VARCHAR) AS c, clndr_data, regexp_extract(clndr_data, 'DaysOfWeek\(\)\((.*)\)\(0\|\|Exceptions', 1) AS w
    FROM (SELECT *, row_number() OVER (PARTITION BY clndr_id ORDER BY loaded_at DESC) AS rn FROM calendar WHERE clndr_id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
  cal_bit AS (SELECT c, i AS day, regexp_split_to_array(w, '\(0\|\|[1-7]\(\)\(')[i + 1] AS d FROM cal_now, (SELECT unnest(range(1, 8)) AS i)),
  cal_day AS (SELECT c, day, [CAST(left(x, 2) AS DOUBLE) + CAST(right(x, 2) AS DOUBLE) / 60 FOR x IN regexp_extract_all(d, 's\|([0-9:]+)', 1)] AS s,
      [CASE WHEN x = '00:00' THEN 24 ELSE CAST(left(x, 2) AS DOUBLE) + CAST(right(x, 2) AS DOUBLE) / 60 END FOR x IN regexp_extract_all(d, 'f\|([0-9:]+)', 1)] AS f FROM cal_bit),
  cal_hours AS (SELECT c, day, coalesce(list_sum(f), 0) - coalesce(list_sum(s), 0) AS h FROM cal_day),
  cal_len AS (SELECT c, CASE WHEN count(DISTINCT h) FILTER (h > 0) = 1 THEN max(h) END AS h, count_if(h > 0) AS n FROM cal_hours GROUP BY 1),
  proj_now AS (SELECT proj_id, nullif(trim(clndr_id), '') AS named FROM (SELECT *, row_number() OVER (PARTITION BY proj_id ORDER BY loaded_at DESC, deleted_at DESC NULLS LAST) AS rn FROM project) WHERE rn = 1 AND deleted_at IS NULL),
  hpd AS (SELECT t.proj_id, p.proj_id IS NOT NULL AS has_row, p.named, l.c, l.n, coalesce(l.h, 8) AS h, CASE WHEN l.h IS NULL THEN 'fallback' ELSE 'programme_calendar' END AS source
    FROM (SELECT DISTINCT proj_id FROM task_now WHERE proj_id IS NOT NULL) t LEFT JOIN proj_now p ON p.proj_id = t.proj_id LEFT JOIN cal_len l ON l.c = p.named)"""
#: The exceptions of each calendar: on_day and whether it works. Follows CAL_SQL.
EXCEPTIONS_SQL = r"""exc AS (SELECT c, DATE '1899-12-30' + CAST(regexp_extract(y, 'd\|([0-9]+)', 1) AS INTEGER) AS on_day, max(right(y, 2)) = '((' AS works
    FROM (SELECT c, unnest(regexp_extract_all(regexp_extract(clndr_data, 'Exceptions\(\)\((.*)', 1), 'd\|[0-9]+\)\(.')) AS y FROM cal_now) GROUP BY ALL)"""
_START = "try_cast(left(coalesce(act_start_date, early_start_date, target_start_date), 10) AS DATE)"
_FINISH = "try_cast(left(coalesce(act_end_date, early_end_date, target_end_date), 10) AS DATE)"
_PCT = "CASE WHEN {d} = 0 THEN 0.0 ELSE floor(CAST({n} AS DOUBLE) / {d} * 1000 + 0.5) / 10 END"


def _pct(n: str, d: str) -> str:
    return _PCT.format(n=n, d=d)


# ---------------------------------------------------------------- mixes and progress


def a1_shape_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks, relationships and WBS nodes of each project, zero-filled."""
    t = tasks_now(spark, folder).where("proj_id IS NOT NULL").groupBy("proj_id").agg(F.count("*").alias("n_tasks"))
    r = links_now(spark, folder).where("proj_id IS NOT NULL").groupBy("proj_id").agg(F.count("*").alias("n_links"))
    w = hierarchy.latest_rows(table(spark, folder, "projwbs"), "wbs_id", "loaded_at").where("proj_id IS NOT NULL").groupBy("proj_id").agg(F.count("*").alias("n_wbs"))
    return t.join(r, "proj_id", "full").join(w, "proj_id", "full").na.fill(0, ["n_tasks", "n_links", "n_wbs"])


def a3_distinct_calendars(spark: SparkSession, folder: str) -> DataFrame:
    """Exact number of calendars in use a project, blanks stripped, null and empty not counted."""
    key = F.nullif(F.trim("clndr_id"), F.lit(""))
    return tasks_now(spark, folder).groupBy("proj_id").agg(F.count_distinct(key).alias("n_calendars"), F.count_distinct("wbs_id").alias("n_wbs_used"))


def a4_status_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks by project and status."""
    return stats.value_mix(tasks_now(spark, folder), ["proj_id"], "status_code", "status_code")


def a4_type_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks by project and type."""
    return stats.value_mix(tasks_now(spark, folder), ["proj_id"], "task_type", "task_type")


def a4_relationship_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Relationships by project and type."""
    return stats.value_mix(links_now(spark, folder), ["proj_id"], "pred_type", "pred_type")


def a6_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Complete share, milestones and baseline mark of each project."""
    return stats.progress(tasks_now(spark, folder), ["proj_id"])


def a5_window_span(spark: SparkSession, folder: str) -> DataFrame:
    """First start, last finish and days between of each project."""
    return stats.window_span(tasks_now(spark, folder), ["proj_id"])


def a2_logic_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Conditional counts: critical tasks, relationships across projects."""
    crit = hierarchy.latest_rows(table(spark, folder, "project"), "proj_id", "loaded_at").select("proj_id", "critical_drtn_hr_cnt")
    t = tasks_now(spark, folder).join(crit, "proj_id", "left").groupBy("proj_id").agg(
        F.count_if(F.col("total_float_hr_cnt") <= F.coalesce("critical_drtn_hr_cnt", F.lit(0.0))).alias("n_critical")
    )
    r = links_now(spark, folder).groupBy("proj_id").agg(F.count_if(F.col("pred_proj_id") != F.col("proj_id")).alias("n_external"))
    return t.join(r, "proj_id", "left").na.fill(0, ["n_external"])


# ---------------------------------------------------------------- distributions


def a13_float_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Total float in days by fixed-edge bucket; nulls apart."""
    days = F.col("total_float_hr_cnt") / F.col("hours_per_day")
    return stats.histogram(tasks_in_days(spark, folder), ["proj_id"], days, stats.FLOAT_EDGES)


def a15_duration_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Target duration in days by bucket, null as 0."""
    days = F.coalesce("target_drtn_hr_cnt", F.lit(0.0)) / F.col("hours_per_day")
    return stats.histogram(tasks_in_days(spark, folder), ["proj_id"], days, stats.DURATION_EDGES)


def a16_float_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Three float bands as whole percentages summing to 100."""
    return stats.float_mix(tasks_in_days(spark, folder), ["proj_id"], "total_float_hr_cnt", F.col("hours_per_day") * stats.HIGH_DAYS)


def a17_s_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly starts, finishes and running finishes of each project."""
    return stats.s_curve(tasks_now(spark, folder).where("proj_id IS NOT NULL"), ["proj_id"])


def a18_card_curve(spark: SparkSession, folder: str) -> DataFrame:
    """The S-curve at 16 points."""
    return stats.card_curve(a17_s_curve(spark, folder), ["proj_id"])


def a19_code_types(spark: SparkSession, folder: str) -> DataFrame:
    """Code types by assigned share: part brands as types, part types as values, orders as activities."""
    part = table(spark, folder, "part")
    lines = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    assigned = lines.select(F.col("l_orderkey").alias("task"), F.col("p_brand").alias("code_type"), F.col("p_type").alias("code")).distinct()
    declared = part.groupBy(F.col("p_brand").alias("code_type")).agg(F.count_distinct("p_type").alias("n_declared"))
    return stats.code_types(assigned, declared, table(spark, folder, "orders").count())


# ---------------------------------------------------------------- quality


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    flagged = quality.flagged_tasks(tasks_in_days(spark, folder).where("proj_id IS NOT NULL"), links_now(spark, folder), data_days(spark, folder), hours_per_day=F.col("hours_per_day"))
    # No assignment table is stored: a task counts as resourced when its type says so.
    return flagged.withColumn("has_resource", F.coalesce(F.col("task_type") == "TT_Rsrc", F.lit(False)))


def q00_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """Passed, applicable and skipped checks of each project."""
    return quality.totals(quality.scorecard(_flagged(spark, folder), links_now(spark, folder)))


def q01_checks(spark: SparkSession, folder: str) -> DataFrame:
    """All 14 checks of each project with count, percentage and state."""
    return quality.scorecard(_flagged(spark, folder), links_now(spark, folder))


def w7_exemplars(spark: SparkSession, folder: str) -> DataFrame:
    """At most 50 worst cases of each failing check."""
    flagged, links = store(_flagged(spark, folder)), links_now(spark, folder)
    return quality.exemplars(flagged, links, quality.scorecard(flagged, links))


def u2_open_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks open at either end, and how."""
    f = _flagged(spark, folder).where("no_pred OR no_succ")
    return f.select("proj_id", "task_id", F.when(F.col("no_pred") & F.col("no_succ"), "both").when(F.col("no_pred"), "start").otherwise("finish").alias("open_end"))


# ---------------------------------------------------------------- network


def j14_driving_links(spark: SparkSession, folder: str) -> DataFrame:
    """Driving predecessors with their gap in minutes, ties kept."""
    return driving.driving_links(tasks_now(spark, folder), links_now(spark, folder))


def g6_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Remaining tasks at each project's last early finish."""
    return driving.seeds(tasks_now(spark, folder).where("proj_id IS NOT NULL"), "proj_id")


def g7_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of each project's driving path."""
    return driving.walk(tasks_now(spark, folder), links_now(spark, folder), "proj_id").select("proj_id", "task_id")


def g8_path_summary(spark: SparkSession, folder: str) -> DataFrame:
    """State, loops, span, share and flag agreement of each project's driving path."""
    tasks = tasks_now(spark, folder)
    return driving.path_summary(tasks, driving.walk(tasks, links_now(spark, folder), "proj_id"), "proj_id")


def a21_flag_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Computed members against the exported flag: both, only one."""
    tasks = tasks_now(spark, folder).where("proj_id IS NOT NULL")
    members = driving.walk(tasks, links_now(spark, folder), "proj_id").select(F.col("task_id").alias("m_id")).distinct()
    flagged, member = F.upper(F.trim(F.coalesce("driving_path_flag", F.lit("")))) == "Y", F.col("m_id").isNotNull()
    return tasks.join(members, F.col("task_id") == F.col("m_id"), "left").groupBy("proj_id").agg(
        F.count_if(flagged & member).alias("n_both"), F.count_if(flagged & ~member).alias("n_only_flag"), F.count_if(~flagged & member).alias("n_only_computed"),
        F.count_if(flagged & (F.col("status_code") != "TK_Complete")).alias("n_flagged_remaining"), F.count_if(flagged & member & (F.col("status_code") != "TK_Complete")).alias("n_agreed_remaining"),
    )


def g20_cpm(spark: SparkSession, folder: str) -> DataFrame:
    """Early and late times, total and free float of every task within its project's network."""
    t = tasks_now(spark, folder).select(F.col("proj_id").alias("key"), "task_id", F.col("target_drtn_hr_cnt").alias("hours"))
    e = links_now(spark, folder).where("pred_id IS NOT NULL AND succ_id IS NOT NULL").select(F.col("proj_id").alias("key"), "pred_id", "succ_id", "pred_type", "lag_hr_cnt")
    return cpm.schedule(t, e)


# ---------------------------------------------------------------- WBS


def g14_tree_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and greatest depth of each project's WBS; nodes on or below loops have no depth."""
    rows = hierarchy.latest_rows(table(spark, folder, "projwbs"), "wbs_id", "loaded_at")
    nodes = rows.select(F.col("wbs_id").cast("string").alias("id"), F.col("parent_wbs_id").cast("string").alias("parent"))
    done = hierarchy.resolve(nodes, F.col("id").try_cast("bigint"), paths=False).select(F.col("id").alias("d_id"), "depth")
    joined = rows.where("proj_id IS NOT NULL").join(done, F.col("wbs_id").cast("string") == F.col("d_id"))
    return joined.groupBy("proj_id").agg(F.count("*").alias("n_nodes"), F.max(F.when(F.col("depth") >= 0, F.col("depth"))).alias("max_depth"))


def g15_subtree_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks in each WBS node's own row and whole subtree; nodes on or below loops only their own."""
    rows = hierarchy.latest_rows(table(spark, folder, "projwbs"), "wbs_id", "loaded_at")
    nodes = rows.select(F.col("wbs_id").cast("string").alias("id"), F.col("parent_wbs_id").cast("string").alias("parent"))
    done = hierarchy.component_roots(nodes, F.col("id").try_cast("bigint"))
    own = tasks_now(spark, folder).where("wbs_id IS NOT NULL").groupBy(F.col("wbs_id").cast("string").alias("v_id")).agg(F.count("*").alias("v"))
    return hierarchy.subtree_sums(done, own).select(F.col("id").cast("bigint").alias("wbs_id"), F.col("own").alias("n_own"), F.col("total").alias("n_subtree"))


# ---------------------------------------------------------------- calendars


def c6_calendars(spark: SparkSession, folder: str) -> DataFrame:
    """Every calendar decoded: state, week and exceptions in numbers."""
    rows = calendars.decoded(table(spark, folder, "calendar"))
    return rows.select(
        "clndr_id", "state", "reason", "working_days_per_week", "hours_per_week", "hours_per_working_day", F.size("exceptions").alias("n_exceptions"), "meaning"
    )


def j16_working_days(spark: SparkSession, folder: str) -> DataFrame:
    """Working days of each task between its start and finish on its own calendar."""
    cal = calendars_now(spark, folder).where("state = 'ok'").select(F.col("clndr_id").cast("string").alias("c_id"), "week", "exceptions")
    t = tasks_now(spark, folder).select("task_id", F.trim("clndr_id").alias("clndr"), real_day(stats.task_start()).alias("d0"), real_day(stats.task_finish()).alias("d1"))
    # The decoded calendars' size follows the number of calendars, so the optimizer decides whether to broadcast them.
    joined = t.join(cal, F.col("clndr") == F.col("c_id"))
    return joined.select("task_id", calendars.working_days(F.col("week"), F.col("exceptions"), F.col("d0"), F.col("d1")).alias("working_days"))


def j11_project_calendars(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar each project works to, or why there is none, and the hours of its day with their source."""
    return project_calendars(spark, folder).select("proj_id", "clndr_id", "state", "reason", "hours_per_day", "hours_source")


def c11_project_working_days(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's window in working days of its own calendar, and the share of activities on that calendar."""
    cal = project_calendars(spark, folder)
    t = tasks_now(spark, folder).join(cal.select(F.col("proj_id").alias("c_proj"), F.col("clndr_id").alias("named")), F.col("proj_id") == F.col("c_proj"))
    on = t.groupBy("proj_id").agg(
        F.min(real_day(stats.task_start())).alias("d0"), F.max(real_day(stats.task_finish())).alias("d1"), percent(F.count_if(F.trim("clndr_id") == F.col("named")), F.count("*")).alias("share")
    )
    ok = F.col("state") == "ok"
    out = cal.join(on, "proj_id").select(
        "proj_id", "state", "clndr_id", "working_days_per_week", F.when(ok, calendars.working_days(F.col("week"), F.col("exceptions"), F.col("d0"), F.col("d1"))).alias("days"), F.when(ok, F.col("share")).alias("activity_share_pct")
    )
    return out


def c8_day_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Day number, weekday (Sunday 1), spreadsheet serial and month index of early starts."""
    d = real_day(F.col("early_start_date"))
    return tasks_now(spark, folder).where(d.isNotNull()).select(
        "task_id", day_number(F.col("early_start_date")).alias("day_no"), F.dayofweek(d).alias("weekday"), (F.unix_date(d) + 25569).alias("serial"),
        (F.year(d) * 12 + F.month(d) - 1).alias("month_no"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        a1_shape_counts, a2_logic_counts, a3_distinct_calendars, a4_status_mix, a4_type_mix, a4_relationship_mix, a5_window_span, a6_progress,
        a13_float_histogram, a15_duration_histogram, a16_float_mix, a17_s_curve, a18_card_curve, a19_code_types, q00_scorecard, q01_checks, w7_exemplars,
        u2_open_ends, j14_driving_links, g6_seeds, g7_members, g8_path_summary, a21_flag_agreement, g20_cpm, g14_tree_depth, g15_subtree_counts,
        c6_calendars, j16_working_days, j11_project_calendars, c11_project_working_days, c8_day_numbers,
    )
}


def _hist(value: str, edges: tuple) -> str:
    arms = " ".join(f"WHEN {value} < {e} THEN {i}" for i, e in enumerate(edges[1:]) if e is not None)
    return f"CASE WHEN {value} IS NULL THEN NULL {arms} ELSE {len(edges) - 2} END"


_MIN = "(epoch(try_cast(left({c}, 10) AS DATE)) / 60 + CAST(substr({c}, 12, 2) AS BIGINT) * 60 + CAST(substr({c}, 15, 2) AS BIGINT))"
_DRIVERS_SQL = f"""{TASKS_SQL}, {LINKS_SQL},
  side AS (SELECT task_id, proj_id, task_type, status_code, CAST({_MIN.format(c="early_start_date")} AS BIGINT) AS es, CAST({_MIN.format(c="early_end_date")} AS BIGINT) AS ef FROM task_now),
  cand AS (SELECT l.succ_id, l.pred_id, l.pred_type, CAST(floor(coalesce(l.lag_hr_cnt, 0) * 60 + 0.5) AS BIGINT) AS lag,
      CASE WHEN l.pred_type IN ('PR_SS', 'PR_SF') THEN p.es ELSE p.ef END AS demand, CASE WHEN l.pred_type IN ('PR_FF', 'PR_SF') THEN s.ef ELSE s.es END AS ref,
      CASE WHEN p.task_type = 'TT_FinMile' THEN 'f' WHEN p.task_type = 'TT_Mile' THEN 's' WHEN l.pred_type IN ('PR_SS', 'PR_SF') THEN 's' ELSE 'f' END AS pk,
      CASE WHEN s.task_type = 'TT_FinMile' THEN 'f' WHEN s.task_type = 'TT_Mile' THEN 's' WHEN l.pred_type IN ('PR_FF', 'PR_SF') THEN 'f' ELSE 's' END AS sk
    FROM link_now l JOIN side p ON p.task_id = l.pred_id JOIN side s ON s.task_id = l.succ_id WHERE p.status_code <> 'TK_Complete'),
  gaps AS (SELECT *, demand + lag - ref AS gap FROM cand WHERE demand + lag - ref IS NOT NULL),
  ranked AS (SELECT *, rank() OVER (PARTITION BY succ_id ORDER BY gap DESC) AS place FROM gaps WHERE NOT (lag = 0 AND gap < 0 AND pk = sk)),
  driving AS (SELECT DISTINCT succ_id, pred_id, pred_type, gap FROM ranked WHERE place = 1)"""
_SEEDS_SQL = """seed AS (SELECT s.proj_id, s.task_id FROM side s JOIN (SELECT proj_id, max(ef) AS m FROM side WHERE status_code <> 'TK_Complete' GROUP BY proj_id) x
    ON x.proj_id = s.proj_id AND x.m = s.ef WHERE s.status_code <> 'TK_Complete')"""
# Members carry the project of the link's successor, as the walk does.
_MEMBERS_SQL = f"""WITH RECURSIVE {_DRIVERS_SQL}, {_SEEDS_SQL},
  edge AS (SELECT DISTINCT s.proj_id, d.succ_id, d.pred_id FROM driving d JOIN side s ON s.task_id = d.succ_id),
  member AS (SELECT proj_id, task_id FROM seed UNION SELECT m.proj_id, e.pred_id FROM member m JOIN edge e ON e.succ_id = m.task_id AND e.proj_id = m.proj_id)"""
_FLAGGED_SQL = f"""{TASKS_SQL}, {LINKS_SQL}, {DAYS_SQL}, {CAL_SQL},
  flagged AS (SELECT t.proj_id, t.task_id, t.total_float_hr_cnt AS tf, t.target_drtn_hr_cnt AS dur, d.data_day,
      t.task_id NOT IN (SELECT succ_id FROM link_now WHERE succ_id IS NOT NULL) AS no_pred, t.task_id NOT IN (SELECT pred_id FROM link_now WHERE pred_id IS NOT NULL) AS no_succ,
      coalesce(t.cstr_type IN ('CS_MANDSTART', 'CS_MANDFIN', 'CS_MSO', 'CS_MEO', 'CS_MSOB', 'CS_MEOB'), false) AS hard,
      coalesce(t.total_float_hr_cnt > 44 * z.h, false) AS hf, coalesce(t.total_float_hr_cnt < 0, false) AS nf, coalesce(t.target_drtn_hr_cnt > 44 * z.h, false) AS hd,
      CASE WHEN d.data_day IS NULL THEN false WHEN try_cast(left(act_start_date, 10) AS DATE) > d.data_day OR try_cast(left(act_end_date, 10) AS DATE) > d.data_day THEN true
        WHEN status_code = 'TK_Complete' THEN false WHEN status_code <> 'TK_Active' AND try_cast(left(early_start_date, 10) AS DATE) < d.data_day THEN true
        ELSE coalesce(try_cast(left(early_end_date, 10) AS DATE) < d.data_day, false) END AS invalid, coalesce(task_type = 'TT_Rsrc', false) AS res
    FROM task_now t LEFT JOIN day_now d ON d.proj_id = t.proj_id JOIN hpd z ON z.proj_id = t.proj_id WHERE t.proj_id IS NOT NULL)"""


def _check(no: int, name: str, count: str, pct: str, state: str) -> str:
    return f"SELECT proj_id, {no} AS check_no, '{name}' AS \"check\", CAST({count} AS BIGINT) AS \"count\", {pct} AS pct, {state} AS state FROM w"


def _state(has: str, ok: str) -> str:
    return f"CASE WHEN NOT ({has}) THEN 'skip' WHEN {ok} THEN 'pass' ELSE 'fail' END"


_SHARES = {"logic": f"greatest({_pct('a', 'n')}, {_pct('b', 'n')})"} | {k: _pct(k, "n") for k in ("hard", "hf", "nf", "hd", "inv", "res")} | {k: _pct(k, "r") for k in ("lead", "lag", "fs")}
_CHECKS_SQL = f"""WITH {_FLAGGED_SQL},
  t AS (SELECT proj_id, count(*) AS n, count_if(no_pred) AS a, count_if(no_succ) AS b, count_if(no_pred OR no_succ) AS open, count_if(hard) AS hard, count_if(hf) AS hf,
      count_if(nf) AS nf, count_if(hd) AS hd, count_if(invalid) AS inv, max(data_day) AS dd, count_if(res) AS res FROM flagged GROUP BY proj_id),
  r AS (SELECT proj_id, count(*) AS r, count_if(lag_hr_cnt < 0) AS lead, count_if(lag_hr_cnt > 0) AS lag, count_if(pred_type = 'PR_FS') AS fs FROM link_now GROUP BY proj_id),
  w AS (SELECT t.*, coalesce(r.r, 0) AS r, coalesce(lead, 0) AS lead, coalesce(lag, 0) AS lag, coalesce(fs, 0) AS fs FROM t LEFT JOIN r USING (proj_id)),
  checks AS (
    {_check(1, "logic", "open", _SHARES["logic"], _state("n > 0", _SHARES["logic"] + " <= 5"))}
    UNION ALL {_check(2, "leads", "lead", _SHARES["lead"], _state("r > 0", "lead = 0"))}
    UNION ALL {_check(3, "lags", "lag", _SHARES["lag"], _state("r > 0", _SHARES["lag"] + " <= 5"))}
    UNION ALL {_check(4, "relationship_types", "r - fs", _SHARES["fs"], _state("r > 0", _SHARES["fs"] + " >= 90"))}
    UNION ALL {_check(5, "hard_constraints", "hard", _SHARES["hard"], _state("n > 0", _SHARES["hard"] + " <= 5"))}
    UNION ALL {_check(6, "high_float", "hf", _SHARES["hf"], _state("n > 0", _SHARES["hf"] + " <= 5"))}
    UNION ALL {_check(7, "negative_float", "nf", _SHARES["nf"], _state("n > 0", "nf = 0"))}
    UNION ALL {_check(8, "high_duration", "hd", _SHARES["hd"], _state("n > 0", _SHARES["hd"] + " <= 5"))}
    UNION ALL {_check(9, "invalid_dates", "inv", _SHARES["inv"], _state("n > 0 AND dd IS NOT NULL", "inv = 0"))}
    UNION ALL {_check(10, "resources", "res", _SHARES["res"], _state("n > 0", "true"))}
    {" ".join("UNION ALL " + _check(i, n, "NULL", "CAST(NULL AS DOUBLE)", "'skip'") for i, n in ((11, "missed_tasks"), (12, "critical_path_test"), (13, "cpli"), (14, "bei")))})"""

_CURVE_SQL = f"""{TASKS_SQL},
  d AS (SELECT proj_id, year({_START}) * 12 + month({_START}) - 1 AS s, year({_FINISH}) * 12 + month({_FINISH}) - 1 AS f FROM task_now WHERE proj_id IS NOT NULL),
  span AS (SELECT proj_id, min(s) AS m0, least(max(f), min(s) + 1199) AS m1 FROM d GROUP BY proj_id HAVING min(s) IS NOT NULL AND max(f) >= min(s)),
  grid AS (SELECT proj_id, m0, unnest(range(m0, m1 + 1)) AS m FROM span),
  ends AS (SELECT d.proj_id, least(greatest(s, m0), m1) AS m, 1 AS a, 0 AS b FROM d JOIN span USING (proj_id) WHERE s IS NOT NULL
    UNION ALL SELECT d.proj_id, least(greatest(f, m0), m1), 0, 1 FROM d JOIN span USING (proj_id) WHERE f IS NOT NULL),
  curve AS (SELECT proj_id, m - m0 AS month_no, starts, finishes, sum(finishes) OVER (PARTITION BY proj_id ORDER BY m) AS cumulative FROM (
    SELECT g.proj_id, g.m, g.m0, CAST(coalesce(sum(a), 0) AS BIGINT) AS starts, CAST(coalesce(sum(b), 0) AS BIGINT) AS finishes
    FROM grid g LEFT JOIN ends e ON e.proj_id = g.proj_id AND e.m = g.m GROUP BY 1, 2, 3))"""

ORACLES = {
    "a1_shape_counts": f"""WITH {TASKS_SQL}, {LINKS_SQL}, t AS (SELECT proj_id, count(*) AS n FROM task_now GROUP BY 1), r AS (SELECT proj_id, count(*) AS n FROM link_now GROUP BY 1),
  w AS (SELECT proj_id, count(*) AS n FROM (SELECT wbs_id, max_by(proj_id, loaded_at) AS proj_id FROM projwbs GROUP BY 1) GROUP BY 1),
  k AS (SELECT proj_id FROM t UNION SELECT proj_id FROM r UNION SELECT proj_id FROM w)
SELECT k.proj_id, coalesce(t.n, 0) AS n_tasks, coalesce(r.n, 0) AS n_links, coalesce(w.n, 0) AS n_wbs FROM k LEFT JOIN t USING (proj_id) LEFT JOIN r USING (proj_id) LEFT JOIN w USING (proj_id) WHERE k.proj_id IS NOT NULL""",
    "a2_logic_counts": f"""WITH {TASKS_SQL}, {LINKS_SQL}, c AS (SELECT proj_id, max_by({{'c': critical_drtn_hr_cnt}}, loaded_at).c AS c FROM project GROUP BY 1)
SELECT t.proj_id, count_if(total_float_hr_cnt <= coalesce(c, 0)) AS n_critical, coalesce(max(x.n), 0) AS n_external FROM task_now t LEFT JOIN c USING (proj_id)
  LEFT JOIN (SELECT proj_id, count_if(pred_proj_id <> proj_id) AS n FROM link_now GROUP BY 1) x USING (proj_id) GROUP BY t.proj_id""",
    "a3_distinct_calendars": f"WITH {TASKS_SQL} SELECT proj_id, count(DISTINCT nullif(trim(clndr_id), '')) AS n_calendars, count(DISTINCT wbs_id) AS n_wbs_used FROM task_now GROUP BY 1",
    "a4_status_mix": f"WITH {TASKS_SQL} SELECT proj_id, status_code, count(*) AS n FROM task_now GROUP BY 1, 2",
    "a4_type_mix": f"WITH {TASKS_SQL} SELECT proj_id, task_type, count(*) AS n FROM task_now GROUP BY 1, 2",
    "a4_relationship_mix": f"WITH {LINKS_SQL} SELECT proj_id, pred_type, count(*) AS n FROM link_now GROUP BY 1, 2",
    "a5_window_span": f"WITH {TASKS_SQL} SELECT proj_id, min({_START}) AS window_start, max({_FINISH}) AS window_finish, CAST(max({_FINISH}) - min({_START}) + 1 AS INTEGER) AS calendar_days FROM task_now GROUP BY 1",
    "a6_progress": f"""WITH {TASKS_SQL} SELECT proj_id, count(*) AS n, count_if(status_code = 'TK_Complete') AS n_complete, {_pct("count_if(status_code = 'TK_Complete')", "count(*)")} AS pct_complete,
  count_if(task_type IN ('TT_Mile', 'TT_FinMile')) AS n_milestones, bool_and(act_start_date IS NULL) AS is_baseline FROM task_now GROUP BY 1""",
    "a13_float_histogram": f"WITH {TASKS_SQL}, {CAL_SQL} SELECT t.proj_id, {_hist('total_float_hr_cnt / coalesce(h, 8)', stats.FLOAT_EDGES)} AS bucket, count(*) AS n FROM task_now t LEFT JOIN hpd z ON z.proj_id = t.proj_id GROUP BY 1, 2",
    "a15_duration_histogram": f"WITH {TASKS_SQL}, {CAL_SQL} SELECT t.proj_id, {_hist('coalesce(target_drtn_hr_cnt, 0) / coalesce(h, 8)', stats.DURATION_EDGES)} AS bucket, count(*) AS n FROM task_now t LEFT JOIN hpd z ON z.proj_id = t.proj_id GROUP BY 1, 2",
    "a16_float_mix": f"""WITH {TASKS_SQL}, {CAL_SQL}, u AS (SELECT t.proj_id, total_float_hr_cnt, 44 * coalesce(h, 8) AS high FROM task_now t LEFT JOIN hpd z ON z.proj_id = t.proj_id), b AS (SELECT proj_id, unnest(['neg', 'ok', 'high']) AS band, unnest([1, 2, 3]) AS ord, unnest([count_if(total_float_hr_cnt < 0),
    count_if(total_float_hr_cnt BETWEEN 0 AND high), count_if(total_float_hr_cnt > high)]) AS n, count(total_float_hr_cnt) AS total FROM u GROUP BY proj_id),
  e AS (SELECT *, CASE WHEN total > 0 THEN n * 100.0::DOUBLE / total ELSE 0 END AS x FROM b),
  f AS (SELECT *, floor(x) AS whole, row_number() OVER (PARTITION BY proj_id ORDER BY x - floor(x) DESC, ord) AS place, CASE WHEN total > 0 THEN 100 - sum(floor(x)) OVER (PARTITION BY proj_id) ELSE 0 END AS spare FROM e),
  g AS (SELECT proj_id, band, CAST(whole + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS pct FROM f)
SELECT proj_id, max(pct) FILTER (band = 'neg') AS neg_pct, max(pct) FILTER (band = 'ok') AS ok_pct, max(pct) FILTER (band = 'high') AS high_pct FROM g GROUP BY 1""",
    "a17_s_curve": f"WITH {_CURVE_SQL} SELECT proj_id, month_no, starts, finishes, CAST(cumulative AS BIGINT) AS cumulative FROM curve",
    "a18_card_curve": f"""WITH {_CURVE_SQL}, k AS (SELECT proj_id, list(cumulative ORDER BY month_no) AS c FROM curve GROUP BY 1), p AS (SELECT *, unnest(range(16)) AS point FROM k)
SELECT proj_id, CAST(point AS INTEGER) AS point, CASE WHEN c[-1] > 0 THEN floor(CAST(c[CAST(floor(point / 15.0::DOUBLE * (len(c) - 1) + 0.5) AS BIGINT) + 1] AS DOUBLE) / c[-1] * 1000 + 0.5) / 1000 ELSE 0 END AS value FROM p""",
    "a19_code_types": f"""WITH u AS (SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), d AS (SELECT p_brand, count(DISTINCT p_type) AS v FROM part GROUP BY 1)
SELECT p_brand AS code_type, v AS value_count, {_pct("coalesce(n, 0)", "(SELECT count(*) FROM orders)")} AS assigned_pct FROM d LEFT JOIN u USING (p_brand) ORDER BY assigned_pct DESC, v DESC, p_brand LIMIT 50""",
    "q01_checks": f"{_CHECKS_SQL} SELECT * FROM checks",
    "q00_scorecard": f"{_CHECKS_SQL} SELECT proj_id, count_if(state = 'pass') AS passed, count_if(state <> 'skip') AS applicable, count_if(state = 'skip') AS skipped FROM checks GROUP BY 1",
    "w7_exemplars": f"""{_CHECKS_SQL}, c AS (SELECT proj_id, task_id, NULL AS pred_id, 1 AS check_no, CASE WHEN no_pred AND no_succ THEN 1.0 ELSE 0 END AS badness FROM flagged WHERE no_pred OR no_succ
    UNION ALL SELECT proj_id, succ_id, pred_id, 2, -lag_hr_cnt FROM link_now WHERE lag_hr_cnt < 0 UNION ALL SELECT proj_id, succ_id, pred_id, 3, lag_hr_cnt FROM link_now WHERE lag_hr_cnt > 0
    UNION ALL SELECT proj_id, task_id, NULL, 5, 0 FROM flagged WHERE hard UNION ALL SELECT proj_id, task_id, NULL, 6, tf FROM flagged WHERE hf UNION ALL SELECT proj_id, task_id, NULL, 7, -tf FROM flagged WHERE nf
    UNION ALL SELECT proj_id, task_id, NULL, 8, dur FROM flagged WHERE hd UNION ALL SELECT proj_id, task_id, NULL, 9, 0 FROM flagged WHERE invalid),
  o AS (SELECT c.*, row_number() OVER (PARTITION BY c.proj_id, c.check_no ORDER BY badness DESC, task_id NULLS FIRST, pred_id NULLS FIRST) AS place FROM c JOIN checks k ON k.proj_id = c.proj_id AND k.check_no = c.check_no AND k.state = 'fail')
SELECT proj_id, task_id, pred_id, check_no, CAST(badness AS DOUBLE) AS badness, CAST(place AS INTEGER) AS place FROM o WHERE place <= 50""",
    "j11_project_calendars": f"""WITH {TASKS_SQL}, {CAL_SQL} SELECT proj_id, named AS clndr_id, CASE WHEN c IS NULL THEN 'unavailable' ELSE 'ok' END AS state,
  CASE WHEN NOT has_row THEN 'the project has no row' WHEN named IS NULL THEN 'the project names no calendar' WHEN c IS NULL THEN 'the named calendar is not there' END AS reason, h AS hours_per_day, source AS hours_source FROM hpd""",
    "j16_working_days": f"""WITH {TASKS_SQL}, {CAL_SQL}, {EXCEPTIONS_SQL}, t AS (SELECT task_id, trim(clndr_id) AS c, {_START} AS a, {_FINISH} AS b FROM task_now WHERE trim(clndr_id) IN (SELECT c FROM cal_now)),
  g AS (SELECT task_id, c, CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM t WHERE a <= b),
  k AS (SELECT task_id, count_if(coalesce(e.works, h.h > 0)) AS n FROM g JOIN cal_hours h ON h.c = g.c AND h.day = dayofweek(g.day) + 1 LEFT JOIN exc e ON e.c = g.c AND e.on_day = g.day GROUP BY 1)
SELECT t.task_id, k.n AS working_days FROM t LEFT JOIN k ON k.task_id = t.task_id""",
    "c11_project_working_days": f"""WITH {TASKS_SQL}, {CAL_SQL}, {EXCEPTIONS_SQL},
  w AS (SELECT t.proj_id, min({_START}) AS a, max({_FINISH}) AS b, {_pct("count_if(trim(clndr_id) = named)", "count(*)")} AS share FROM task_now t JOIN hpd z ON z.proj_id = t.proj_id GROUP BY 1),
  g AS (SELECT w.proj_id, z.c, CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM w JOIN hpd z ON z.proj_id = w.proj_id WHERE z.c IS NOT NULL),
  k AS (SELECT g.proj_id, count_if(coalesce(e.works, h.h > 0)) AS n FROM g JOIN cal_hours h ON h.c = g.c AND h.day = dayofweek(g.day) + 1 LEFT JOIN exc e ON e.c = g.c AND e.on_day = g.day GROUP BY 1)
SELECT z.proj_id, CASE WHEN c IS NULL THEN 'unavailable' ELSE 'ok' END AS state, named AS clndr_id, z.n AS working_days_per_week, k.n AS days, CASE WHEN c IS NOT NULL THEN share END AS activity_share_pct FROM hpd z JOIN w ON w.proj_id = z.proj_id LEFT JOIN k ON k.proj_id = z.proj_id""",
    "u2_open_ends": f"WITH {_FLAGGED_SQL} SELECT proj_id, task_id, CASE WHEN no_pred AND no_succ THEN 'both' WHEN no_pred THEN 'start' ELSE 'finish' END AS open_end FROM flagged WHERE no_pred OR no_succ",
    "j14_driving_links": f"WITH {_DRIVERS_SQL} SELECT * FROM driving",
    "g6_seeds": f"WITH {_DRIVERS_SQL}, {_SEEDS_SQL} SELECT proj_id, task_id FROM seed",
    "g7_members": f"{_MEMBERS_SQL} SELECT proj_id, task_id FROM member",
    "a21_flag_agreement": f"""{_MEMBERS_SQL}, m AS (SELECT DISTINCT task_id FROM member), x AS (SELECT t.proj_id, upper(trim(coalesce(driving_path_flag, ''))) = 'Y' AS flag, m.task_id IS NOT NULL AS mem, status_code <> 'TK_Complete' AS live
    FROM task_now t LEFT JOIN m USING (task_id) WHERE proj_id IS NOT NULL)
SELECT proj_id, count_if(flag AND mem) AS n_both, count_if(flag AND NOT mem) AS n_only_flag, count_if(mem AND NOT flag) AS n_only_computed, count_if(flag AND live) AS n_flagged_remaining, count_if(flag AND mem AND live) AS n_agreed_remaining FROM x GROUP BY 1""",
    "c8_day_numbers": f"""WITH {TASKS_SQL}, d AS (SELECT task_id, try_cast(left(early_start_date, 10) AS DATE) AS d FROM task_now)
SELECT task_id, CAST(d - DATE '1970-01-01' AS INTEGER) AS day_no, CAST(dayofweek(d) + 1 AS INTEGER) AS weekday, CAST(d - DATE '1970-01-01' + 25569 AS INTEGER) AS serial, CAST(year(d) * 12 + month(d) - 1 AS INTEGER) AS month_no FROM d WHERE d IS NOT NULL""",
}
