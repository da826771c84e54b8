"""Queries of the general data problems over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.operators import drift, hierarchy, orphans, rejects
from schedlake.sources.tables import table

# ---------------------------------------------------------------- 1: schemas that drift


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every schema change of every export."""
    changed = drift.changes(table(spark, folder, "xer_table"), table(spark, folder, "revision"))
    return changed.select("file_id", "table_name", "change_kind", "field_name")


def p1_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The migration steps between neighbouring schema versions."""
    return drift.migration_steps(drift.changes(table(spark, folder, "xer_table"), table(spark, folder, "revision")))


def p1_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The schema versions of each programme's tables: fingerprint, first export, size, and what the revisions call them."""
    found = drift.versions(drift.paired_exports(table(spark, folder, "xer_table"), table(spark, folder, "revision")))
    return found.select("programme_id", "table_name", "version_no", "file_id", "rev_no", "fingerprint", F.size("names").alias("n_fields"), "n_exports", "p6_versions")


def p1_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of each programme's consistent tables: final name and type, first and last revision that hold them."""
    xer = table(spark, folder, "xer_table")
    paired = drift.paired_exports(xer, table(spark, folder, "revision"))
    return drift.consistent_schema(drift.lineage(paired, drift.changes(xer, table(spark, folder, "revision"), paired)))


def p1_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all exports under their final field names and types."""
    return drift.consistent_rows(table(spark, folder, "xer_table"), table(spark, folder, "revision"))


# ---------------------------------------------------------------- 2: rows that fail to parse


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and scans that cannot be loaded, with the first reason."""
    return rejects.found(table(spark, folder, "xer_line"), table(spark, folder, "scan_log"))


def p2_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The sound rows of the raw exports."""
    return rejects.load_rows(table(spark, folder, "xer_line"))


def p2_scans(spark: SparkSession, folder: str) -> DataFrame:
    """The sound scans, typed."""
    return rejects.load_scans(table(spark, folder, "scan_log"))


# ---------------------------------------------------------------- 4: references to nothing


def _tables(spark: SparkSession, folder: str) -> dict[str, orphans.Table]:
    read = lambda name: table(spark, folder, name)
    # A project's own node heads its tree: what it names as parent lies outside.
    wbs = read("projwbs").withColumn("parent_wbs_id", F.when(F.coalesce("proj_node_flag", F.lit("")) != "Y", F.col("parent_wbs_id")))
    return {
        "taskpred": orphans.Table("taskpred", read("taskpred"), "task_pred_id", deleted_at=None),
        "task": orphans.Table("task", read("task"), "task_id", deleted_refers=False),
        "projwbs": orphans.Table("projwbs", wbs, "wbs_id", deleted_at=None),
        "project": orphans.Table("project", read("project"), "proj_id", deleted_refers=False),
        "calendar": orphans.Table("calendar", read("calendar"), "clndr_id"),
        "revision": orphans.Table("revision", read("revision"), "id", loaded_at="uploaded_at", deleted_at="removed_at"),
        "programme": orphans.Table("programme", read("programme"), "id", loaded_at="created_at", deleted_at=None),
    }


REFERENCES = [
    orphans.Reference("taskpred", "pred_task_id", "task"),
    orphans.Reference("taskpred", "pred_proj_id", "project"),
    orphans.Reference("task", "clndr_id", "calendar"),
]
#: The foreign-key graph an orphan's absence runs down.
GRAPH = [
    *REFERENCES,
    orphans.Reference("taskpred", "task_id", "task"),
    orphans.Reference("task", "proj_id", "project"),
    orphans.Reference("task", "wbs_id", "projwbs"),
    orphans.Reference("projwbs", "parent_wbs_id", "projwbs"),
    orphans.Reference("projwbs", "proj_id", "project"),
    orphans.Reference("project", "clndr_id", "calendar"),
    orphans.Reference("revision", "programme_id", "programme"),
    orphans.Reference("programme", "parent_programme_id", "programme"),
]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Direct orphans of the three references; what hangs below orphans is in ``p4_cascade``."""
    found = orphans.Cascade(_tables(spark, folder), REFERENCES).direct
    return found.select("table_name", "field_name", F.col("record_key").try_cast("bigint").alias("record_id"), "reason", "period")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every orphaned record of the whole foreign-key graph: direct (level 0) or inherited, with the number of links to the nearest direct one."""
    return orphans.orphan_cascade(_tables(spark, folder), GRAPH)


def p4_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """``p4_records`` counted per table, field, month, level and reason."""
    found = p4_records(spark, folder)
    return found.groupBy("table_name", "field_name", "period", "level", F.coalesce("reason", F.lit("inherited")).alias("reason")).agg(
        F.count("*").alias("n_records")
    )


# ---------------------------------------------------------------- 5: parent links


def wbs_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each WBS node as (id, parent, proj_node_flag)."""
    src = table(spark, folder, "projwbs").select("wbs_id", "parent_wbs_id", "proj_node_flag", "loaded_at")
    rows = hierarchy.latest_rows(src, "wbs_id", "loaded_at", "parent_wbs_id", "proj_node_flag")
    return rows.select(F.col("wbs_id").cast("string").alias("id"), F.col("parent_wbs_id").cast("string").alias("parent"), "proj_node_flag")


def programme_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Each programme once as (id, parent, stored_root)."""
    src = table(spark, folder, "programme").select("id", "parent_programme_id", "root_programme_id", "created_at")
    rows = hierarchy.latest_rows(src, "id", "created_at", "parent_programme_id", "root_programme_id")
    return rows.select("id", F.col("parent_programme_id").alias("parent"), F.col("root_programme_id").alias("stored_root"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of both trees with root, depth and what is wrong with its links."""
    wbs, prog = wbs_nodes(spark, folder), programme_nodes(spark, folder)
    none = F.lit(None).cast("struct<id:string>")
    both = wbs.select(F.lit("projwbs").alias("tree_name"), "id", "parent", (F.col("proj_node_flag") == "Y").alias("excused"), none.alias("stored_root")).unionByName(
        prog.select(F.lit("programme").alias("tree_name"), "id", "parent", F.lit(False).alias("excused"), F.struct(F.col("stored_root").alias("id")).alias("stored_root"))
    )
    return hierarchy.tree_facts(both, ["projwbs"])


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    wbs = hierarchy.resolve(wbs_nodes(spark, folder), F.col("id").try_cast("bigint")).withColumn("tree_name", F.lit("projwbs"))
    return wbs.unionByName(hierarchy.resolve(programme_nodes(spark, folder)).withColumn("tree_name", F.lit("programme")))


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every node's full path, depth, root, pre-order span and loop marks."""
    return _resolved(spark, folder).select(
        "tree_name", F.col("id").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"),
        F.array_join("path", "/").alias("path"), "on_loop", "back_edge", "enter", "leave",
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every node below each node of both trees, with the number of links between."""
    wbs = hierarchy.descendants(hierarchy.resolve(wbs_nodes(spark, folder), F.col("id").try_cast("bigint")))
    prog = hierarchy.descendants(hierarchy.resolve(programme_nodes(spark, folder)))
    named = [d.select(F.lit(n).alias("tree_name"), F.col("id").alias("node_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("int").alias("distance")) for n, d in (("projwbs", wbs), ("programme", prog))]
    return named[0].unionByName(named[1])


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_steps, p1_versions, p1_fields, p1_consistent, p2_found, p2_rows, p2_scans, p4_found, p4_records, p4_cascade, p5_found, p5_paths, p5_descendants)
}

_STATE = """SELECT trim(CAST({key} AS VARCHAR)) AS k, min(loaded_at) AS f, max_by({gone}, loaded_at) AS g{more}
  FROM {table} WHERE {key} IS NOT NULL GROUP BY 1"""


def _wbs_sql() -> str:
    return """wbs AS (SELECT CAST(wbs_id AS VARCHAR) AS id, CAST(r.p AS VARCHAR) AS parent, r.flag AS flag, wbs_id AS rank
    FROM (SELECT wbs_id, max_by({'p': parent_wbs_id, 'flag': proj_node_flag}, loaded_at) AS r FROM projwbs GROUP BY wbs_id)),
  prog AS (SELECT DISTINCT id, parent_programme_id AS parent, root_programme_id AS stored FROM programme)"""


def _tree_sql(name: str, src: str, rank: str) -> str:
    """Chains walked upward until a root or a repeated node."""
    return f"""{name}_walk AS (
    SELECT id, id AS cur, parent, [id] AS seen, false AS looped FROM {src}
    UNION ALL
    SELECT w.id, s.id, s.parent, list_append(w.seen, s.id), list_contains(w.seen, s.id)
    FROM {name}_walk w JOIN {src} s ON s.id = w.parent WHERE NOT w.looped),
  {name}_end AS (SELECT id, arg_max(cur, len(seen)) AS last, arg_max(seen, len(seen)) AS seen, bool_or(looped) AS looped FROM {name}_walk GROUP BY id),
  {name}_done AS (SELECT id, looped, CASE WHEN looped THEN -1 ELSE len(seen) - 1 END AS depth,
    CASE WHEN looped THEN (SELECT arg_min(x, {rank}) FROM (SELECT unnest(seen[list_position(seen, last):]) AS x)) ELSE last END AS root,
    looped AND list_position(seen, last) = 1 AS on_loop FROM {name}_end)"""


_NUMBER = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"
_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9])?"
_INSTANT = "[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_FIELD = '("[^"]*("{2}[^"]*)*"|[^",][^,]*|)'
_COUNTS = (3, 8, 9, 10, 13)

_KIND = f"""CASE WHEN v = '' THEN NULL WHEN regexp_full_match(v, '{_NUMBER}') THEN 'number' WHEN v IN ('Y', 'N') THEN 'flag'
      WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} ([01][0-9]|2[0-3]):[0-5][0-9]') AND left(v, 4) <> '0000' AND try_cast(left(v, 10) AS DATE) IS NOT NULL THEN 'stamp' ELSE 'text' END"""
_STEP_NO = "CASE kind WHEN 'renamed' THEN 1 WHEN 'added' THEN 2 WHEN 'removed' THEN 3 ELSE 4 END"
_DRIFT_SQL = f"""WITH x AS (SELECT file_id, table_name, fields, cells FROM (SELECT *, row_number() OVER (PARTITION BY file_id, table_name ORDER BY seq_no) AS rn FROM xer_table) WHERE rn = 1),
  e AS (SELECT r.programme_id, r.rev_no, x.*, lag(x.file_id) OVER (PARTITION BY r.programme_id, table_name ORDER BY r.rev_no, x.file_id) AS old_file,
      CASE table_name WHEN 'PROJECT' THEN 'proj_id' WHEN 'PROJWBS' THEN 'wbs_id' WHEN 'TASK' THEN 'task_id' WHEN 'TASKPRED' THEN 'task_pred_id' END AS k FROM x JOIN revision r ON r.file_id = x.file_id WHERE r.programme_id IS NOT NULL),
  f AS (SELECT file_id, table_name, lower(trim(fields[i])) AS name, min(i) AS i FROM e, (SELECT unnest(range(1, 200)) AS i) WHERE i <= len(fields) GROUP BY 1, 2, 3),
  c AS (SELECT file_id, table_name, unnest(cells) AS a, generate_subscripts(cells, 1) AS pos FROM e),
  v AS (SELECT c.file_id, c.table_name, f.name, c.pos, trim(coalesce(c.a[f.i], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM c JOIN f ON f.file_id = c.file_id AND f.table_name = c.table_name),
  w AS (SELECT *, {_KIND} AS kind, CASE WHEN v = '' THEN NULL WHEN regexp_full_match(v, '{_NUMBER}') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE v END AS said FROM v),
  n AS (SELECT file_id, table_name, name, kind, count(*) AS n FROM w WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4),
  t AS (SELECT file_id, table_name, name, arg_max(kind, (n, CASE kind WHEN 'number' THEN 4 WHEN 'stamp' THEN 3 WHEN 'flag' THEN 2 ELSE 1 END)) AS kind, sum(n) AS n FROM n GROUP BY 1, 2, 3),
  plus AS (SELECT e.file_id, e.table_name, e.old_file, e.k, f.name FROM e JOIN f ON f.file_id = e.file_id AND f.table_name = e.table_name WHERE old_file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.file_id = e.old_file AND g.table_name = e.table_name AND g.name = f.name)),
  minus AS (SELECT e.file_id, e.table_name, e.old_file, f.name FROM e JOIN f ON f.file_id = e.old_file AND f.table_name = e.table_name WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.file_id = e.file_id AND g.table_name = e.table_name AND g.name = f.name)),
  keyed AS (SELECT e.file_id, e.table_name, e.old_file, EXISTS (SELECT 1 FROM f WHERE f.file_id = e.file_id AND f.table_name = e.table_name AND name = k) AND EXISTS (SELECT 1 FROM f WHERE f.file_id = e.old_file AND f.table_name = e.table_name AND name = k) AS by_key, k FROM e WHERE old_file IS NOT NULL),
  rk AS (SELECT q.file_id, q.table_name, q.side, q.src, c.pos, CASE WHEN by_key THEN coalesce((SELECT said FROM w WHERE w.file_id = q.src AND w.table_name = q.table_name AND w.pos = c.pos AND w.name = q.k), '') ELSE CAST(c.pos AS VARCHAR) END AS row_key
    FROM (SELECT *, file_id AS src, 'new' AS side FROM keyed UNION ALL SELECT *, old_file, 'old' FROM keyed) q JOIN c ON c.file_id = q.src AND c.table_name = q.table_name),
  one AS (SELECT file_id, table_name, side, src, row_key, min(pos) AS pos FROM rk GROUP BY 1, 2, 3, 4, 5),
  met AS (SELECT a.file_id, a.table_name, a.src AS new_at, a.pos AS new_pos, b.src AS old_at, b.pos AS old_pos FROM one a JOIN one b ON b.file_id = a.file_id AND b.table_name = a.table_name AND b.row_key = a.row_key AND a.side = 'new' AND b.side = 'old'),
  score AS (SELECT m.file_id, m.table_name, o.name AS old_name, p.name AS new_name, avg(CASE WHEN x.said = y.said THEN 1.0 ELSE 0 END) AS score FROM met m JOIN plus p ON p.file_id = m.file_id AND p.table_name = m.table_name JOIN minus o ON o.file_id = m.file_id AND o.table_name = m.table_name
    JOIN w x ON x.file_id = m.new_at AND x.table_name = m.table_name AND x.pos = m.new_pos AND x.name = p.name JOIN w y ON y.file_id = m.old_at AND y.table_name = m.table_name AND y.pos = m.old_pos AND y.name = o.name WHERE x.said IS NOT NULL OR y.said IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING score >= 0.8),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id, table_name, new_name ORDER BY score DESC, levenshtein(old_name, new_name), old_name, new_name) AS by_new, row_number() OVER (PARTITION BY file_id, table_name, old_name ORDER BY score DESC, levenshtein(old_name, new_name), old_name, new_name) AS by_old FROM score),
  ren AS (SELECT * FROM ranked WHERE by_new = 1 AND by_old = 1),
  cases AS (SELECT file_id, table_name, 'renamed' AS kind, old_name AS field_name, new_name AS target FROM ren
    UNION ALL SELECT file_id, table_name, 'added', name, NULL FROM plus p WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_id = p.file_id AND r.table_name = p.table_name AND r.new_name = p.name)
    UNION ALL SELECT file_id, table_name, 'removed', name, NULL FROM minus p WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_id = p.file_id AND r.table_name = p.table_name AND r.old_name = p.name)
    UNION ALL SELECT e.file_id, e.table_name, 'retyped', a.name, a.kind FROM e JOIN t a ON a.file_id = e.file_id AND a.table_name = e.table_name JOIN t b ON b.file_id = e.old_file AND b.table_name = e.table_name AND b.name = a.name
      WHERE a.kind <> b.kind AND 2 * (a.n - coalesce((SELECT n FROM n WHERE n.file_id = a.file_id AND n.table_name = a.table_name AND n.name = a.name AND n.kind = b.kind), 0)) > a.n)"""


def _edge(child: str, field: str, parent: str) -> str:
    alive = " AND NOT g" if child in ("task", "project") else ""
    return f"SELECT '{child}' AS ct, '{field}' AS field, k AS ck, strftime(f, '%Y-%m') AS period, '{parent}' AS pt, r.{field} AS pk, f FROM s_{child} WHERE r.{field} IS NOT NULL{alive}"


def _state_of(name: str, source: str, key: str, at: str, gone: str, fields: list[str]) -> str:
    refs = ", ".join(f"'{f}': nullif(trim(CAST({f} AS VARCHAR)), '')" for f in fields) or "'none': 0"
    return f"s_{name} AS (SELECT trim(CAST({key} AS VARCHAR)) AS k, min({at}) AS f, max_by({gone}, {at}) AS g, max_by({{{refs}}}, {at}) AS r FROM {source} WHERE {key} IS NOT NULL GROUP BY 1)"


_KEYS = {"taskpred": ("task_pred_id", "loaded_at", "false"), "task": ("task_id", "loaded_at", "deleted_at IS NOT NULL"), "projwbs": ("wbs_id", "loaded_at", "false"), "project": ("proj_id", "loaded_at", "deleted_at IS NOT NULL"),
         "calendar": ("clndr_id", "loaded_at", "deleted_at IS NOT NULL"), "revision": ("id", "uploaded_at", "removed_at IS NOT NULL"), "programme": ("id", "created_at", "false")}
_OWN_WBS = "(SELECT * REPLACE (CASE WHEN coalesce(proj_node_flag, '') <> 'Y' THEN parent_wbs_id END AS parent_wbs_id) FROM projwbs)"
_CASCADE_SQL = f"""WITH RECURSIVE {", ".join(_state_of(t, _OWN_WBS if t == "projwbs" else t, *_KEYS[t], [r.field for r in GRAPH if r.child == t]) for t in _KEYS)},
  edge AS ({" UNION ALL ".join(_edge(r.child, r.field, r.parent) for r in GRAPH)}),
  target AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, k, f, g FROM s_{t}" for t in _KEYS)}),
  direct AS (SELECT ct, field, ck, period, CASE WHEN x.k IS NULL THEN 'missing' WHEN x.g THEN 'deleted' WHEN x.f > e.f THEN 'late' END AS reason FROM edge e LEFT JOIN target x ON x.t = e.pt AND x.k = e.pk),
  hang AS (SELECT DISTINCT ct, ck, 0 AS level FROM direct WHERE reason IS NOT NULL UNION SELECT e.ct, e.ck, h.level + 1 FROM hang h JOIN edge e ON e.pt = h.ct AND e.pk = h.ck WHERE h.level < 900),
  least_ AS (SELECT ct, ck, min(level) AS level FROM hang GROUP BY 1, 2),
  rec AS (SELECT ct AS table_name, field AS field_name, period, 0 AS level, reason FROM direct WHERE reason IS NOT NULL
    UNION ALL SELECT ct, field, period, level, 'inherited' FROM (SELECT l.ct, l.ck, l.level, min(e.field) AS field, min(e.period) AS period FROM least_ l JOIN edge e ON e.ct = l.ct AND e.ck = l.ck JOIN least_ u ON u.ct = e.pt AND u.ck = e.pk AND u.level = l.level - 1 WHERE l.level > 0 GROUP BY 1, 2, 3))"""

ORACLES = {
    "p1_found": f"{_DRIFT_SQL} SELECT file_id, table_name, kind AS change_kind, field_name FROM cases",
    "p1_steps": f"""{_DRIFT_SQL} SELECT e.programme_id, c.table_name, e.rev_no, c.file_id, {_STEP_NO} AS step_no, CASE kind WHEN 'renamed' THEN 'rename' WHEN 'added' THEN 'default' WHEN 'removed' THEN 'drop' ELSE 'cast' END AS step, field_name, target
FROM cases c JOIN e ON e.file_id = c.file_id AND e.table_name = c.table_name""",
    "p4_cascade": f"{_CASCADE_SQL} SELECT table_name, field_name, period, level, reason, count(*) AS n_records FROM rec GROUP BY 1, 2, 3, 4, 5",
    "p2_found": rf"""WITH l AS (SELECT line_id, file_id, line_no, regexp_replace(coalesce(line, ''), '\r$', '') AS line FROM xer_line WHERE file_id IS NOT NULL AND line_no IS NOT NULL),
  m AS (SELECT *, split_part(line, chr(9), 1) AS head, head IN ('ERMHDR', '%T', '%F', '%R', '%E') AS mark FROM l),
  c AS (SELECT *, sum(CAST(mark AS INTEGER)) OVER w AS grp, sum(CASE WHEN head = '%T' THEN 1 ELSE 0 END) OVER w AS tab FROM m WINDOW w AS (PARTITION BY file_id ORDER BY line_no, line_id)),
  f AS (SELECT *, last_value(CASE WHEN head = '%F' THEN lower(substr(line, 4)) END IGNORE NULLS) OVER (PARTITION BY file_id, tab ORDER BY line_no, line_id) AS fields,
      first_value(CASE WHEN head = '%T' THEN substr(line, 4) END) OVER (PARTITION BY file_id, tab ORDER BY line_no, line_id) AS tn FROM c),
  g AS (SELECT arg_min(line_id, (line_no, line_id)) AS id, arg_min(head, (line_no, line_id)) AS head, arg_min(tn, (line_no, line_id)) AS tn, string_split(arg_min(fields, (line_no, line_id)), chr(9)) AS fl,
      arg_min(line, (line_no, line_id)) AS first, string_agg(line, chr(10) ORDER BY line_no, line_id) AS body FROM f GROUP BY file_id, grp),
  r AS (SELECT *, string_split(substr(body, CASE WHEN contains(first, chr(9)) THEN 4 ELSE 3 END), chr(9)) AS a, CASE tn WHEN 'TASK' THEN 'task_id' WHEN 'PROJWBS' THEN 'wbs_id' WHEN 'TASKPRED' THEN 'task_pred_id' END AS k FROM g WHERE head = '%R'),
  s AS (SELECT log_id, regexp_full_match(raw, '{_FIELD}(,{_FIELD})*') AS ok, [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN [y[2:] FOR y IN regexp_extract_all(',' || raw, ',{_FIELD}')]] AS a
    FROM scan_log WHERE raw <> '{",".join(rejects.SCAN_COLUMNS)}'),
  judged AS (
    SELECT 'xer_line' AS record_source, id AS record_id, CASE WHEN fl IS NULL THEN 'no_fields' WHEN contains(body, chr(0)) THEN 'nul' WHEN len(a) <> len(fl) THEN 'column_count'
      WHEN k IS NOT NULL AND list_contains(fl, k) AND NOT regexp_full_match(a[list_position(fl, k)], '{_NUMBER}') THEN 'bad_key'
      WHEN len([i FOR i IN range(1, len(fl) + 1) IF regexp_matches(a[i], '\S') AND ((suffix(fl[i], '_cnt') AND NOT regexp_full_match(a[i], '{_NUMBER}'))
        OR (suffix(fl[i], '_date') AND NOT (regexp_full_match(a[i], '{_DATE}') AND left(a[i], 4) <> '0000' AND try_cast(left(a[i], 10) AS DATE) IS NOT NULL)))]) > 0 THEN 'bad_value' END AS reason FROM r
    UNION ALL SELECT 'scan_log', log_id, CASE WHEN NOT ok THEN 'broken_quote' WHEN len(a) <> 13 THEN 'column_count' WHEN NOT regexp_full_match(a[1], '0*[1-9][0-9]*') THEN 'bad_key'
      WHEN NOT (regexp_full_match(a[2], '{_INSTANT}') AND left(a[2], 4) <> '0000' AND try_cast(left(a[2], 10) AS DATE) IS NOT NULL) OR NOT regexp_full_match(a[4], '[0-9a-fA-F]{{64}}')
        OR {" OR ".join(f"NOT regexp_full_match(a[{i}], '[0-9]+')" for i in _COUNTS)} OR {" OR ".join(f"a[{i}] NOT IN ('true', 'false')" for i in (6, 7, 11))}
        OR {" OR ".join(f"try_cast(a[{i}] AS HUGEINT) > try_cast(a[3] AS HUGEINT)" for i in (8, 9, 10))} THEN 'bad_value' END FROM s)
SELECT record_source, record_id, reason FROM judged WHERE reason IS NOT NULL""",
    "p2_scans": r"""WITH s AS (SELECT * FROM scan_log
    WHERE raw <> 'file_id,scanned_at,bytes,content_hash,p6_version,starts_with_ermhdr,reaches_end_marker,nul_byte_count,trailing_nul_run,complete_bytes,tokenizer_ok,tokenizer_detail,activity_count'
      AND regexp_full_match(raw, '("[^"]*("{2}[^"]*)*"|[^",][^,]*|)(,("[^"]*("{2}[^"]*)*"|[^",][^,]*|))*')),
  c AS (SELECT log_id, logged_at, [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END
      FOR x IN [y[2:] FOR y IN regexp_extract_all(',' || raw, ',("[^"]*("{2}[^"]*)*"|[^",][^,]*|)')]] AS a FROM s)
SELECT log_id, logged_at, CAST(a[1] AS BIGINT) AS file_id, try_cast(a[2] AS TIMESTAMP) AS scanned_at, CAST(a[3] AS DECIMAL(38,0)) AS bytes,
  a[4] AS content_hash, a[5] AS p6_version, a[6] = 'true' AS starts_with_ermhdr, a[7] = 'true' AS reaches_end_marker,
  CAST(a[8] AS DECIMAL(38,0)) AS nul_byte_count, CAST(a[9] AS DECIMAL(38,0)) AS trailing_nul_run, CAST(a[10] AS DECIMAL(38,0)) AS complete_bytes,
  a[11] = 'true' AS tokenizer_ok, a[12] AS tokenizer_detail, CAST(a[13] AS DECIMAL(38,0)) AS activity_count
FROM c WHERE len(a) = 13 AND regexp_full_match(a[1], '0*[1-9][0-9]*')
  AND regexp_full_match(a[2], '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}') AND try_cast(a[2] AS TIMESTAMP) IS NOT NULL
  AND regexp_full_match(a[3], '[0-9]+') AND regexp_full_match(a[8], '[0-9]+') AND regexp_full_match(a[9], '[0-9]+')
  AND regexp_full_match(a[10], '[0-9]+') AND regexp_full_match(a[13], '[0-9]+') AND regexp_full_match(a[4], '[0-9a-fA-F]{64}')
  AND CAST(a[8] AS HUGEINT) <= CAST(a[3] AS HUGEINT) AND CAST(a[9] AS HUGEINT) <= CAST(a[3] AS HUGEINT) AND CAST(a[10] AS HUGEINT) <= CAST(a[3] AS HUGEINT)
  AND a[6] IN ('true', 'false') AND a[7] IN ('true', 'false') AND a[11] IN ('true', 'false')""",
    "p4_found": f"""WITH tk AS ({_STATE.format(key="task_id", table="task", gone="deleted_at IS NOT NULL", more=", max_by({'c': nullif(trim(clndr_id), '')}, loaded_at).c AS c")}),
  pj AS ({_STATE.format(key="proj_id", table="project", gone="deleted_at IS NOT NULL", more="")}),
  ca AS ({_STATE.format(key="clndr_id", table="calendar", gone="deleted_at IS NOT NULL", more="")}),
  tp AS ({_STATE.format(key="task_pred_id", table="taskpred", gone="false", more=", max_by({'t': CAST(pred_task_id AS VARCHAR), 'p': nullif(trim(pred_proj_id), '')}, loaded_at) AS r")}),
  refs AS (
    SELECT 'taskpred' AS table_name, 'pred_task_id' AS field_name, tp.k AS id, tp.f, tk.k AS tkey, tk.f AS tf, tk.g AS tg FROM tp LEFT JOIN tk ON tp.r.t = tk.k WHERE tp.r.t IS NOT NULL
    UNION ALL SELECT 'taskpred', 'pred_proj_id', tp.k, tp.f, pj.k, pj.f, pj.g FROM tp LEFT JOIN pj ON tp.r.p = pj.k WHERE tp.r.p IS NOT NULL
    UNION ALL SELECT 'task', 'clndr_id', tk.k, tk.f, ca.k, ca.f, ca.g FROM tk LEFT JOIN ca ON tk.c = ca.k WHERE tk.c IS NOT NULL AND NOT tk.g),
  judged AS (SELECT *, CASE WHEN tkey IS NULL THEN 'missing' WHEN tg THEN 'deleted' WHEN tf > f THEN 'late' END AS reason FROM refs)
SELECT table_name, field_name, CAST(id AS BIGINT) AS record_id, reason, strftime(f, '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL""",
    "p5_found": f"""WITH RECURSIVE {_wbs_sql()}, {_tree_sql("w", "wbs", "CAST(x AS BIGINT)")}, {_tree_sql("p", "prog", "x")}
SELECT 'projwbs' AS tree_name, id AS node_id, root AS root_id, CAST(depth AS INTEGER) AS depth, CASE WHEN on_loop THEN 'cycle' WHEN looped THEN 'below_cycle'
    WHEN depth = 0 AND parent IS NOT NULL AND coalesce(flag, '') <> 'Y' THEN 'dangling' ELSE 'ok' END AS finding
  FROM w_done JOIN wbs USING (id)
UNION ALL SELECT 'programme', id, root, CAST(depth AS INTEGER), CASE WHEN on_loop THEN 'cycle' WHEN looped THEN 'below_cycle'
    WHEN depth = 0 AND parent IS NOT NULL THEN 'dangling' WHEN stored IS DISTINCT FROM root THEN 'wrong_root' ELSE 'ok' END
  FROM p_done JOIN prog USING (id)""",
    "p5_descendants": f"""WITH RECURSIVE {_wbs_sql()}, {_tree_sql("w", "wbs", "CAST(x AS BIGINT)")}, {_tree_sql("p", "prog", "x")},
  whole AS (SELECT 'projwbs' AS tree_name, w.id, w.cur, len(w.seen) - 1 AS n FROM w_walk w JOIN w_done d ON d.id = w.id WHERE NOT d.looped
    UNION ALL SELECT 'programme', w.id, w.cur, len(w.seen) - 1 FROM p_walk w JOIN p_done d ON d.id = w.id WHERE NOT d.looped)
SELECT tree_name, cur AS node_id, id AS descendant_id, CAST(n AS INTEGER) AS distance FROM whole WHERE n > 0""",
}
