"""Reference operators over raw exports: records, notes, headers, scans, typed tables, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions.text import byte_text, decode_report
from schedlake.operators import documents, driving, hierarchy, quality, rejects, stats
from schedlake.plans import tasks as T
from schedlake.session import store
from schedlake.plans.problems import ORACLES as PROBLEM_SQL
from schedlake.sources import exports, lines
from schedlake.sources.tables import table


def s1_decode_report(spark: SparkSession, folder: str) -> DataFrame:
    """Byte facts of the task and WBS names of each file that a single-byte file can hold."""
    names = table(spark, folder, "task").select("file_id", F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("task_name").alias("name"))
    # A WBS node stands in the files of its project; repeated rows of a project name a file once.
    files = table(spark, folder, "project").select("proj_id", "file_id").distinct()
    wbs = table(spark, folder, "projwbs").join(files, "proj_id").select("file_id", F.lit("projwbs").alias("kind"), F.col("wbs_id").alias("id"), F.col("wbs_name").alias("name"))
    # A record loaded again under the same name stands in its file once.
    names = names.unionByName(wbs).where("name IS NOT NULL AND file_id IS NOT NULL").distinct()
    latin = byte_text(F.col("name"))
    facts = decode_report(latin)
    kept = names.where(~latin.rlike(r"[^\u0000-ÿ]"))
    return kept.groupBy("file_id").agg(*[F.sum(c).alias(n) for n, c in facts.items()])


def s3_records(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, joined rows and rows of wrong arity per file and table."""
    r = lines.row_records(table(spark, folder, "xer_line"))
    cells = F.length("line") - F.length(F.translate("line", "\t", "")) + 1 + F.coalesce("extra_tabs", F.lit(0))
    bad = F.coalesce(F.size(F.split("fields", "\t", -1)) != cells, F.lit(True))
    return r.groupBy("file_id", "table_name").agg(F.count("*").alias("n_rows"), F.count("extra_lines").alias("n_joined"), F.count_if(bad).alias("n_bad"))


def s5_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Soft notes per file: rows joined from several lines, files without an end record."""
    raw = table(spark, folder, "xer_line")
    joined = lines.row_records(raw).where("extra_lines > 0").select("file_id", F.lit("joined_row").alias("reason"), "line_no")
    ends = lines.numbered_lines(raw).groupBy("file_id").agg(F.count_if(F.col("marker") == "%E").alias("n"), F.max("line_no").alias("line_no"))
    return joined.unionByName(ends.where("n = 0").select("file_id", F.lit("no_end_record").alias("reason"), "line_no"))


def s7_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The header of each raw export."""
    return exports.headers(table(spark, folder, "xer_line"))


def s9_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Records per file and marker, counted without splitting a cell."""
    src = lines.numbered_lines(table(spark, folder, "xer_line"))
    return src.groupBy("file_id").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("marker") == "%T").alias("n_tables"), F.count_if(F.col("marker") == "%R").alias("n_rows"),
        F.count_if(F.col("marker").isNull()).alias("n_continued"), F.count_if(F.col("marker") == "%E").alias("n_ends"),
    )


def s10_readability(spark: SparkSession, folder: str) -> DataFrame:
    """The readability facts on texts."""
    facts = exports.readability(F.col("text"))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", *[facts[n].cast("int").alias(n) for n in facts])


def s14_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The typed TASK table of the sound rows."""
    return exports.typed_table(rejects.load_rows(table(spark, folder, "xer_line")), "TASK")


def s14_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """The typed TASKPRED table of the sound rows."""
    return exports.typed_table(rejects.load_rows(table(spark, folder, "xer_line")), "TASKPRED")


def s19_json(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON column read with a schema."""
    e = table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


def f19_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The guard ladder over sound scans: verdicts counted. A file's projects are those its stored tasks name."""
    scans = rejects.load_scans(table(spark, folder, "scan_log"))
    projects = table(spark, folder, "task").groupBy(F.col("file_id").alias("t_file")).agg(F.count_distinct("proj_id").alias("n"))
    scans = scans.join(projects, F.col("file_id") == F.col("t_file"), "left").withColumn("project_count", F.coalesce("n", F.lit(1)))
    return exports.verdict(scans).groupBy("verdict").agg(F.count("*").alias("n"))


def a22_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct planners per file of the catalogue's projects, with the first and last finish."""
    p = hierarchy.latest_rows(table(spark, folder, "project"), "proj_id", "loaded_at")
    return p.groupBy("file_id").agg(F.count_distinct("add_by_name").alias("n_planners"), F.min("plan_start_date").alias("first_start"), F.max("plan_end_date").alias("last_end"))


def k1_activities(spark: SparkSession, folder: str) -> DataFrame:
    """The activity document with driving-path membership."""
    t = T.tasks_now(spark, folder).where("proj_id IS NOT NULL")
    return documents.activities(t, driving.walk(t, T.links_now(spark, folder), "proj_id"))


def k2_derived(spark: SparkSession, folder: str) -> DataFrame:
    """The derived document of each project, all its groups."""
    t, links = store(T.tasks_in_days(spark, folder).where("proj_id IS NOT NULL")), store(T.links_now(spark, folder))
    flagged = store(T._flagged(spark, folder))
    card = store(quality.scorecard(flagged, links))
    time = stats.window_span(t, ["proj_id"]).join(T.data_days(spark, folder), "proj_id", "left").join(T.c11_project_working_days(spark, folder).select("proj_id", F.struct("state", "days", "clndr_id", "activity_share_pct").alias("working_days")), "proj_id", "left")
    walked = store(driving.walk(t, links, "proj_id"))
    path = driving.path_details(t, links, walked, T.data_minutes(spark, folder), "proj_id")
    open_ends = flagged.groupBy("proj_id").agg(F.count_if("no_pred").alias("n_no_pred"), F.count_if("no_succ").alias("n_no_succ"))
    logic = path.join(open_ends, "proj_id", "left").join(T.a2_logic_counts(spark, folder), "proj_id", "left")
    floats = stats.float_mix(t, ["proj_id"], "total_float_hr_cnt", F.col("hours_per_day") * stats.HIGH_DAYS)
    curve = store(stats.s_curve(t, ["proj_id"]))
    line = stats.card_curve(curve, ["proj_id"]).groupBy("proj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "value"))), lambda p: p["value"]).alias("curve"))
    bars = lambda days, edges, name: stats.histogram(t, ["proj_id"], days, edges).groupBy("proj_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col("bucket").cast("string"), F.lit("none")), "n"))).alias(name))
    mix = stats.value_mix(t, ["proj_id"], "task_type", "v").groupBy("proj_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("v", F.lit("")), "n"))).alias("types"))
    spread = mix.join(bars(F.col("total_float_hr_cnt") / F.col("hours_per_day"), stats.FLOAT_EDGES, "float_days"), "proj_id").join(
        bars(F.coalesce("target_drtn_hr_cnt", F.lit(0.0)) / F.col("hours_per_day"), stats.DURATION_EDGES, "duration_days"), "proj_id"
    )
    # At most 1,200 months a project.
    months = curve.groupBy("proj_id").agg(F.array_sort(F.collect_list(F.struct("month_no", "starts", "finishes", "cumulative"))).alias("s_curve"))
    groups = {
        "shape": T.a1_shape_counts(spark, folder), "time": time, "progress": stats.progress(t, ["proj_id"]), "logic": logic, "quality": quality.totals(card), "distributions": spread,
        "card": floats.join(line, "proj_id", "left"),
    }
    return documents.derived(groups, {"exemplars": quality.exemplars(flagged, links, card), "s_curve": months})


def k4_facets(spark: SparkSession, folder: str) -> DataFrame:
    """The facet row of each project: counts, version, window, progress and scorecard in one row."""
    t = T.tasks_now(spark, folder).where("proj_id IS NOT NULL")
    card = quality.totals(quality.scorecard(T._flagged(spark, folder), T.links_now(spark, folder)))
    project = hierarchy.latest_rows(table(spark, folder, "project"), "proj_id", "loaded_at").select("proj_id", "file_id")
    version = project.join(table(spark, folder, "revision").select("file_id", "p6_version"), "file_id").select("proj_id", "p6_version")
    out = stats.progress(t, ["proj_id"]).join(stats.window_span(t, ["proj_id"]), "proj_id").join(card, "proj_id", "left").join(T.data_days(spark, folder), "proj_id", "left").join(version, "proj_id", "left")
    return out.select(
        "proj_id", "p6_version", F.col("n").alias("activity_count"), "window_start", "window_finish", "data_day", "pct_complete", "is_baseline", "passed", "applicable", F.lit(documents.DERIVED_VERSION).alias("derived_version")
    )


QUERIES = {
    f.__name__: f
    for f in (
        s1_decode_report, s3_records, s5_issues, s7_headers, s9_scan, s10_readability, s14_tasks, s14_relationships, s19_json, f19_verdicts, a22_disclosure,
        k1_activities, k2_derived, k4_facets,
    )
}

SCAN_SQL = PROBLEM_SQL["p2_scans"]
_LINES = r"""l AS (SELECT line_id, file_id, line_no, regexp_replace(coalesce(line, ''), '\r$', '') AS line FROM xer_line WHERE file_id IS NOT NULL AND line_no IS NOT NULL),
  m AS (SELECT *, CASE WHEN split_part(line, chr(9), 1) IN ('ERMHDR', '%T', '%F', '%R', '%E') THEN split_part(line, chr(9), 1) END AS marker FROM l)"""
_RECORDS = rf"""{_LINES},
  c AS (SELECT *, sum(CASE WHEN marker IS NOT NULL THEN 1 ELSE 0 END) OVER w AS grp, sum(CASE WHEN marker = '%T' THEN 1 ELSE 0 END) OVER w AS tab FROM m WINDOW w AS (PARTITION BY file_id ORDER BY line_no, line_id)),
  f AS (SELECT *, last_value(CASE WHEN marker = '%F' THEN substr(line, 4) END IGNORE NULLS) OVER (PARTITION BY file_id, tab ORDER BY line_no, line_id) AS fields,
      first_value(CASE WHEN marker = '%T' THEN substr(line, 4) END) OVER (PARTITION BY file_id, tab ORDER BY line_no, line_id) AS table_name FROM c),
  g AS (SELECT file_id, grp, arg_min(marker, (line_no, line_id)) AS marker, arg_min(table_name, (line_no, line_id)) AS table_name, arg_min(fields, (line_no, line_id)) AS fields, min(line_no) AS line_no,
      count(*) - 1 AS extra, sum(length(line) - length(replace(line, chr(9), ''))) - CASE WHEN contains(arg_min(line, (line_no, line_id)), chr(9)) THEN 1 ELSE 0 END + 1 AS cells FROM f GROUP BY 1, 2),
  r AS (SELECT * FROM g WHERE marker = '%R')"""

ORACLES = {
    "f19_verdicts": f"""WITH s AS ({SCAN_SQL}), p AS (SELECT file_id, count(DISTINCT proj_id) AS n FROM task GROUP BY 1),
  v AS (SELECT CASE WHEN bytes > 125829120 THEN 'oversize' WHEN NOT reaches_end_marker OR nul_byte_count > 0 THEN 'unreadable' WHEN NOT starts_with_ermhdr THEN 'not_xer' WHEN NOT tokenizer_ok THEN 'tokenizer' WHEN activity_count = 0 THEN 'no_activities'
    WHEN coalesce(p.n, 1) > 1 THEN 'multi_project' WHEN activity_count > 20000 THEN 'activity_cap' WHEN bytes > 62914560 THEN 'byte_cap' ELSE 'accept' END AS verdict FROM s LEFT JOIN p ON p.file_id = s.file_id) SELECT verdict, count(*) AS n FROM v GROUP BY 1""",
    "s3_records": f"WITH {_RECORDS} SELECT file_id, table_name, count(*) AS n_rows, count_if(extra > 0) AS n_joined, count_if(coalesce(len(string_split(fields, chr(9))) <> cells, true)) AS n_bad FROM r GROUP BY 1, 2",
    "s5_issues": f"""WITH {_RECORDS} SELECT file_id, 'joined_row' AS reason, line_no FROM r WHERE extra > 0
UNION ALL SELECT file_id, 'no_end_record', max(line_no) FROM m GROUP BY 1 HAVING count_if(marker = '%E') = 0""",
    "s7_headers": r"""WITH h AS (SELECT file_id, string_split(regexp_replace(arg_min(line, (line_no, line_id)), '\r$', ''), chr(9)) AS a FROM xer_line WHERE regexp_matches(line, '^ERMHDR(\t|\r?$)') GROUP BY 1)
SELECT file_id, nullif(a[2], '') AS version, nullif(a[3], '') AS exported_on, nullif(a[4], '') AS export_type, nullif(a[5], '') AS login, nullif(a[6], '') AS user_name, nullif(a[7], '') AS database, nullif(a[9], '') AS currency FROM h""",
    "s9_scan": f"""WITH {_LINES} SELECT file_id, count(*) AS n_lines, count_if(marker = '%T') AS n_tables, count_if(marker = '%R') AS n_rows, count_if(marker IS NULL) AS n_continued, count_if(marker = '%E') AS n_ends FROM m GROUP BY 1""",
    "s10_readability": r"""SELECT doc_id, CAST(starts_with(text, 'ERMHDR') AS INTEGER) AS starts_with_ermhdr, CAST(regexp_matches(text, '(^|\n)%E[\r\n]*$') AS INTEGER) AS reaches_end_marker,
  CAST(length(text) - length(replace(text, chr(0), '')) AS INTEGER) AS nul_byte_count, CAST(length(text) - length(rtrim(text, chr(0))) AS INTEGER) AS trailing_nul_run, CAST(length(rtrim(text, chr(0))) AS INTEGER) AS complete_bytes
FROM documents WHERE text IS NOT NULL""",
    "s19_json": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "a22_disclosure": """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proj_id ORDER BY loaded_at DESC) AS rn FROM project) WHERE rn = 1)
SELECT file_id, count(DISTINCT add_by_name) AS n_planners, min(plan_start_date) AS first_start, max(plan_end_date) AS last_end FROM p GROUP BY 1""",
    "k1_activities": f"""{T._MEMBERS_SQL}, mm AS (SELECT DISTINCT task_id FROM member)
SELECT proj_id, t.task_id, task_code, task_name, wbs_id, task_type, status_code, target_drtn_hr_cnt, remain_drtn_hr_cnt, total_float_hr_cnt, early_start_date, early_end_date, act_start_date, act_end_date,
  mm.task_id IS NOT NULL AS driving FROM task_now t LEFT JOIN mm ON mm.task_id = t.task_id WHERE proj_id IS NOT NULL""",
    "k4_facets": f"""{T._CHECKS_SQL}, card AS (SELECT proj_id, count_if(state = 'pass') AS passed, count_if(state <> 'skip') AS applicable FROM checks GROUP BY 1)
SELECT t.proj_id, max(p6_version) AS p6_version, 4 AS derived_version, count(*) AS activity_count, min({T._START}) AS window_start, max({T._FINISH}) AS window_finish, max(d.data_day) AS data_day, {T._pct("count_if(status_code = 'TK_Complete')", "count(*)")} AS pct_complete,
  bool_and(act_start_date IS NULL) AS is_baseline, max(passed) AS passed, max(applicable) AS applicable FROM task_now t LEFT JOIN day_now d ON d.proj_id = t.proj_id LEFT JOIN card c ON c.proj_id = t.proj_id
  LEFT JOIN (SELECT q.proj_id, r.p6_version FROM (SELECT proj_id, max_by(file_id, loaded_at) AS file_id FROM project GROUP BY 1) q JOIN revision r ON r.file_id = q.file_id) v ON v.proj_id = t.proj_id WHERE t.proj_id IS NOT NULL GROUP BY 1""",
}
