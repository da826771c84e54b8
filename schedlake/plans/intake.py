"""Reference operators over exports as they come in: notes, tables, scan facts, searches, gates and alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.operators import rejects
from schedlake.plans.exports import _LINES, _RECORDS
from schedlake.plans.problems import ORACLES as PROBLEM_SQL
from schedlake.sources import exports, lines
from schedlake.sources.tables import table


def s5_notes(spark: SparkSession, folder: str) -> DataFrame:
    """All soft notes of the tokenizer: a header after line 1, an unnamed table, a second field list, a joined row, a line that continues nothing."""
    c = lines.carried_lines(table(spark, folder, "xer_line"))
    unnamed = F.trim(lines.after_marker(F.col("line"))) == ""
    # A field list is the first of its table if the last one before it stands before the table's line.
    before = Window.partitionBy("file_id", "t_at.line_id").orderBy("line_no", "line_id")
    lists = c.where("marker = '%F'").withColumn("nth", F.row_number().over(before)).where("nth > 1")
    note = lambda df, reason: df.select("file_id", F.lit(reason).alias("reason"), "line_no")
    joined = c.where("marker IS NULL AND open.marker = '%R'").groupBy("file_id", F.col("open.line_id").alias("o_id")).agg(F.min("line_no").alias("line_no"))
    return (
        note(c.where("marker = 'ERMHDR' AND line_no > 1"), "late_header").unionByName(note(c.where((F.col("marker") == "%T") & unnamed), "unnamed_table"))
        .unionByName(note(lists, "second_fields")).unionByName(note(joined, "joined_row")).unionByName(note(c.where("marker IS NULL AND (open IS NULL OR open.marker <> '%R')"), "orphan_line"))
    )


def s6_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's tables: how often declared, rows in all, and whether the file was ended after its last table or header."""
    src = lines.numbered_lines(table(spark, folder, "xer_line"))
    declared = src.where("marker = '%T'").groupBy("file_id", lines.after_marker(F.col("line")).alias("table_name")).agg(F.count("*").alias("n_declared"))
    rows = lines.openers(lines.carried_lines(table(spark, folder, "xer_line"))).groupBy(F.col("file_id").alias("r_file"), F.col("table_name").alias("r_table")).agg(F.count("*").alias("n_rows"))
    last = lambda test: F.max(F.when(test, F.col("line_no")))
    ends = src.groupBy(F.col("file_id").alias("e_file")).agg((last(F.col("marker") == "%E") > F.coalesce(last(F.col("marker").isin("%T", "ERMHDR")), F.lit(0))).alias("terminated"))
    out = declared.join(rows, (F.col("file_id") == F.col("r_file")) & (F.col("table_name") == F.col("r_table")), "left").join(ends, F.col("file_id") == F.col("e_file"))
    return out.select("file_id", "table_name", "n_declared", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("terminated", F.lit(False)).alias("terminated"))


def s9_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A file's scan: activities, first start and last finish as written, distinct projects; only the cells it needs are cut out."""
    rows = lines.openers(lines.carried_lines(table(spark, folder, "xer_line"))).where("table_name = 'TASK' AND fields IS NOT NULL")
    rows = rows.select("file_id", F.split("fields", "\t", -1).alias("fields"), F.split("line", "\t", -1).alias("cells"))
    cell = lambda n: F.nullif(F.trim(exports.cell(n)), F.lit(""))
    return rows.groupBy("file_id").agg(
        F.count("*").alias("n_activities"), F.min(cell("early_start_date")).alias("first_start"), F.max(cell("early_end_date")).alias("last_finish"), F.count_distinct(cell("proj_id")).alias("n_projects")
    )


def s14_wbs(spark: SparkSession, folder: str) -> DataFrame:
    """The typed PROJWBS table of the sound rows."""
    return exports.typed_table(rejects.load_rows(table(spark, folder, "xer_line")), "PROJWBS")


def s14_projects(spark: SparkSession, folder: str) -> DataFrame:
    """The typed PROJECT table of the sound rows."""
    return exports.typed_table(rejects.load_rows(table(spark, folder, "xer_line")), "PROJECT")


def s20_grep(spark: SparkSession, folder: str) -> DataFrame:
    """Files that hold a name anywhere, in any case, with the number of lines."""
    hit = F.contains(F.lower("line"), F.lit("slab"))
    return table(spark, folder, "xer_line").where(hit & F.col("file_id").isNotNull()).groupBy("file_id").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


def t2_gate_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Each revision against the content hashes of those before it: removed, duplicate (of a root, for a root), or clear."""
    r = table(spark, folder, "revision")
    first = F.struct("uploaded_at", "file_id")
    h = r.where("content_hash IS NOT NULL").groupBy(F.col("content_hash").alias("h")).agg(
        F.bool_or(F.col("removal_class") == "B").alias("blocked"), F.min(F.when(F.col("is_root_rev") & (F.col("status") == "published"), first)).alias("root")
    )
    later = F.col("is_root_rev") & F.col("root").isNotNull() & (F.struct("uploaded_at", "file_id") > F.col("root"))
    outcome = F.when(F.coalesce("blocked", F.lit(False)), "removed").when(F.coalesce(later, F.lit(False)), "duplicate").otherwise("clear")
    return r.join(h, F.col("content_hash") == F.col("h"), "left").select("id", outcome.alias("outcome"))


def t8_burst_alarms(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which failed uploads burst (five, or over half of four attempts and more), and whether each alarms: on the first day of a run, then daily."""
    r = table(spark, folder, "revision").where("uploaded_at IS NOT NULL")
    days = r.groupBy(F.to_date("uploaded_at").alias("day")).agg(F.count("*").alias("attempts"), F.count_if(F.col("failure_reason").isNotNull()).alias("failures"))
    burst = (F.col("failures") >= 5) | ((F.col("attempts") >= 4) & (F.col("failures") / F.col("attempts") > 0.5))
    on = days.withColumn("burst", burst)
    before = on.select(F.date_add("day", 1).alias("b_day"), F.col("burst").alias("was"))
    return on.join(before, F.col("day") == F.col("b_day"), "left").select("day", "attempts", "failures", "burst", (F.col("burst") & ~F.coalesce("was", F.lit(False))).alias("transition"))


def t11_rolling_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Each upload with its uploader's uploads of the 24 hours up to it, and whether that exceeds 20."""
    r = table(spark, folder, "revision").where("uploader_display_name IS NOT NULL AND uploaded_at IS NOT NULL")
    at = F.unix_micros(F.col("uploaded_at").cast("timestamp"))
    day = Window.partitionBy("uploader_display_name").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return r.select("id", "uploader_display_name", at.alias("at")).withColumn("n_24h", F.count("*").over(day)).select("id", "n_24h", (F.col("n_24h") > 20).alias("over"))


QUERIES = {f.__name__: f for f in (s5_notes, s6_tables, s9_facts, s14_wbs, s14_projects, s20_grep, t2_gate_outcomes, t8_burst_alarms, t11_rolling_gate)}

#: The rows that the strict load takes, with their field lists and cells: the parts of the reject query before its verdict.
_SOUND = PROBLEM_SQL["p2_found"].rpartition("SELECT record_source, record_id, reason FROM judged")[0] + """,
  sound AS (SELECT f.file_id, f.line_no, r.tn, r.fl, r.a FROM r JOIN f ON f.line_id = r.id WHERE r.id NOT IN (SELECT record_id FROM judged WHERE record_source = 'xer_line' AND reason IS NOT NULL))"""


def typed_sql(name: str) -> str:
    """The typed table of the sound rows."""

    def column(field: str, kind: str) -> str:
        text = f"nullif(trim(a[list_position(fl, '{field}')], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '')"
        return f"{text} AS {field}" if kind == "text" else f"CAST(try_cast({text} AS DOUBLE) AS {'BIGINT' if kind == 'id' else 'DOUBLE'}) AS {field}"

    spec = exports.TYPED[name]
    first, kind = next(iter(spec.items()))
    keep = f" WHERE {first} IS NOT NULL" if kind == "id" else ""
    return f"{_SOUND} SELECT * FROM (SELECT file_id, line_no, {', '.join(column(f, k) for f, k in spec.items())} FROM sound WHERE tn = '{name}'){keep}"


ORACLES = {
    "s5_notes": f"""WITH {_RECORDS}, o AS (SELECT *, last_value(CASE WHEN marker IS NOT NULL THEN marker END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no, line_id) AS op,
      last_value(CASE WHEN marker IS NOT NULL THEN line_id END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no, line_id) AS oid, row_number() OVER (PARTITION BY file_id, tab, marker ORDER BY line_no, line_id) AS nth FROM c)
SELECT file_id, 'late_header' AS reason, line_no FROM o WHERE marker = 'ERMHDR' AND line_no > 1 UNION ALL SELECT file_id, 'unnamed_table', line_no FROM o WHERE marker = '%T' AND trim(substr(line, 4)) = ''
UNION ALL SELECT file_id, 'second_fields', line_no FROM o WHERE marker = '%F' AND nth > 1 UNION ALL SELECT file_id, 'joined_row', min(line_no) FROM o WHERE marker IS NULL AND op = '%R' GROUP BY file_id, oid
UNION ALL SELECT file_id, 'orphan_line', line_no FROM o WHERE marker IS NULL AND op IS DISTINCT FROM '%R'""",
    "s6_tables": f"""WITH {_RECORDS}, d AS (SELECT file_id, substr(line, 4) AS table_name, count(*) AS n_declared FROM m WHERE marker = '%T' GROUP BY 1, 2), n AS (SELECT file_id, table_name, count(*) AS n_rows FROM r GROUP BY 1, 2),
  e AS (SELECT file_id, coalesce(max(line_no) FILTER (marker = '%E') > coalesce(max(line_no) FILTER (marker IN ('%T', 'ERMHDR')), 0), false) AS terminated FROM m GROUP BY 1)
SELECT d.file_id, d.table_name, n_declared, coalesce(n_rows, 0) AS n_rows, terminated FROM d LEFT JOIN n ON n.file_id = d.file_id AND n.table_name = d.table_name JOIN e ON e.file_id = d.file_id""",
    "s9_facts": f"""WITH {_RECORDS}, t AS (SELECT f.file_id, string_split(lower(f.fields), chr(9)) AS fl, string_split(substr(f.line, 4), chr(9)) AS a FROM f WHERE marker = '%R' AND table_name = 'TASK' AND fields IS NOT NULL)
SELECT file_id, count(*) AS n_activities, min(nullif(trim(a[list_position(fl, 'early_start_date')]), '')) AS first_start, max(nullif(trim(a[list_position(fl, 'early_end_date')]), '')) AS last_finish, count(DISTINCT nullif(trim(a[list_position(fl, 'proj_id')]), '')) AS n_projects FROM t GROUP BY 1""",
    "s20_grep": "SELECT file_id, count(*) AS n_lines, min(line_no) AS first_line FROM xer_line WHERE contains(lower(line), 'slab') AND file_id IS NOT NULL GROUP BY 1",
    "t2_gate_outcomes": """SELECT id, CASE WHEN EXISTS (SELECT 1 FROM revision x WHERE x.content_hash = r.content_hash AND x.removal_class = 'B') THEN 'removed'
  WHEN is_root_rev AND EXISTS (SELECT 1 FROM revision x WHERE x.content_hash = r.content_hash AND x.is_root_rev AND x.status = 'published' AND (x.uploaded_at, x.file_id) < (r.uploaded_at, r.file_id)) THEN 'duplicate' ELSE 'clear' END AS outcome FROM revision r""",
    "t8_burst_alarms": """WITH d AS (SELECT CAST(uploaded_at AS DATE) AS day, count(*) AS attempts, count(failure_reason) AS failures FROM revision WHERE uploaded_at IS NOT NULL GROUP BY 1),
  b AS (SELECT *, failures >= 5 OR (attempts >= 4 AND failures * 2 > attempts) AS burst FROM d) SELECT b.*, b.burst AND NOT coalesce(y.burst, false) AS transition FROM b LEFT JOIN b y ON y.day = b.day - 1""",
    "t11_rolling_gate": """SELECT id, n AS n_24h, n > 20 AS over FROM (SELECT id, count(*) OVER (PARTITION BY uploader_display_name ORDER BY uploaded_at RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n
  FROM revision WHERE uploader_display_name IS NOT NULL AND uploaded_at IS NOT NULL)""",
} | {query: typed_sql(name) for query, name in (("s14_tasks", "TASK"), ("s14_relationships", "TASKPRED"), ("s14_wbs", "PROJWBS"), ("s14_projects", "PROJECT"))}
