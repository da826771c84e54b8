"""Reference operators of the browsing views: paths in detail, WBS summaries, the activity table, pages and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.functions import formats
from schedlake.functions.numbers import percent
from schedlake.operators import catalogue as cat
from schedlake.operators import driving, hierarchy, stats
from schedlake.plans import shelf as S
from schedlake.plans import tasks as T
from schedlake.session import store
from schedlake.sources.tables import table

# ---------------------------------------------------------------- driving paths


def _details(spark: SparkSession, folder: str) -> DataFrame:
    tasks, links = store(T.tasks_now(spark, folder).where("proj_id IS NOT NULL")), store(T.links_now(spark, folder))
    return driving.path_details(tasks, links, store(driving.walk(tasks, links, "proj_id")), T.data_minutes(spark, folder), "proj_id")


def g9_path_details(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's driving path: members, branches, open ends and whether they are grounded, truncation, continuity, days."""
    return _details(spark, folder)


def g12_trace_issues(spark: SparkSession, folder: str) -> DataFrame:
    """The notes a path owes: a loop is an error; truncation and members that differ from the exported flag are remarks."""
    d = _details(spark, folder)
    note = lambda test, severity, reason: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason")))
    differs = (F.col("n_flagged") > 0) & ((F.col("n_flagged") > F.col("n_agreed")) | (F.col("n_members") > F.col("n_agreed")))
    notes = F.array_compact(F.array(note(F.col("has_loop"), "error", "loop"), note(F.col("truncated"), "info", "truncated"), note(differs, "info", "flag_differs")))
    return d.select("proj_id", F.explode(notes).alias("n")).select("proj_id", "n.*")


def g13_float_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks without positive float, which is another thing than the driving path."""
    return T.tasks_now(spark, folder).where("total_float_hr_cnt <= 0").select("proj_id", "task_id")


def g19_fork_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Programmes with a removed revision and all their forks, with the distance to the nearest such ancestor."""
    bad = table(spark, folder, "revision").where("removal_class IS NOT NULL AND programme_id IS NOT NULL").select(F.col("programme_id").alias("b_id")).distinct()
    p = S.programmes(spark, folder).select("id", F.col("parent_programme_id").alias("parent"))
    below = hierarchy.descendants(hierarchy.resolve(p)).join(bad, F.col("id") == F.col("b_id")).select(F.col("descendant").alias("id"), "distance")
    own = p.join(bad, F.col("id") == F.col("b_id")).select("id", F.lit(0).alias("distance"))
    return own.unionByName(below).groupBy(F.col("id").alias("programme_id")).agg(F.min("distance").cast("int").alias("distance"))


# ---------------------------------------------------------------- WBS


def _wbs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The latest rows of the WBS, and per node its depth with own and subtree activities."""
    rows = hierarchy.latest_rows(table(spark, folder, "projwbs"), "wbs_id", "loaded_at")
    nodes = rows.select(F.col("wbs_id").cast("string").alias("id"), F.col("parent_wbs_id").cast("string").alias("parent"))
    done = store(hierarchy.component_roots(nodes, F.col("id").try_cast("bigint")))
    own = T.tasks_now(spark, folder).where("wbs_id IS NOT NULL").groupBy(F.col("wbs_id").cast("string").alias("v_id")).agg(F.count("*").alias("v"))
    sums = hierarchy.subtree_sums(done, own).join(done.select(F.col("id").alias("d_id"), "depth"), F.col("id") == F.col("d_id"))
    return rows, sums.select(F.col("id").cast("bigint").alias("s_id"), "depth", "own", "total")


def g15_first_level(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's 20 first-level WBS nodes of most activities, and whether there are more.

    First level: no project node, with no parent, a missing one, or a project node above.
    """
    rows, sums = _wbs(spark, folder)
    top = F.col("proj_node_flag") == "Y"
    parents = rows.select(F.col("wbs_id").alias("p_id"), F.coalesce(top, F.lit(False)).alias("p_top"))
    first = rows.where(~F.coalesce(top, F.lit(False)) & F.col("proj_id").isNotNull()).join(parents, F.col("parent_wbs_id") == F.col("p_id"), "left").where("p_id IS NULL OR p_top")
    named = first.join(sums, F.col("wbs_id") == F.col("s_id")).select(
        "proj_id", "wbs_id", F.coalesce(F.nullif("wbs_name", F.lit("")), "wbs_short_name").alias("name"), F.col("total").alias("activity_count")
    )
    n = named.groupBy(F.col("proj_id").alias("n_proj")).agg((F.count("*") > 20).alias("truncated"))
    order = Window.partitionBy("proj_id").orderBy(F.desc("activity_count"), "wbs_id")
    ranked = named.withColumn("place", F.row_number().over(order)).where("place <= 20")
    return ranked.join(n, F.col("proj_id") == F.col("n_proj")).drop("n_proj")


def g16_wbs_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every WBS node outside loops with its depth, own activities and those of its subtree."""
    _, sums = _wbs(spark, folder)
    return sums.where("depth >= 0").select(F.col("s_id").alias("wbs_id"), F.col("depth").cast("int").alias("depth"), F.col("own").alias("n_own"), F.col("total").alias("n_subtree"))


# ---------------------------------------------------------------- the activity table


def f14_table_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The activity table's filters at once: in the subtree of a project's first WBS root, not complete, open at an end (check 1), text, driving or not."""
    rows = hierarchy.latest_rows(table(spark, folder, "projwbs"), "wbs_id", "loaded_at")
    nodes = rows.select(F.col("wbs_id").cast("string").alias("id"), F.col("parent_wbs_id").cast("string").alias("parent"))
    done = hierarchy.component_roots(nodes, F.col("id").try_cast("bigint")).where("depth >= 0").select(F.col("id").cast("bigint").alias("w_id"), F.col("root").cast("bigint").alias("root"))
    # A root's subtree is its whole tree.
    wanted = rows.where("proj_id IS NOT NULL").join(done, F.col("wbs_id") == F.col("w_id")).where("root = wbs_id").groupBy("proj_id").agg(F.min("root").alias("wanted"))
    flagged = T._flagged(spark, folder)
    t = flagged.join(done, F.col("wbs_id") == F.col("w_id")).join(wanted.select("wanted"), F.col("root") == F.col("wanted"), "left_semi")
    text = F.lower(F.concat_ws(" ", "task_code", "task_name"))
    kept = t.where((F.col("status_code") != "TK_Complete") & (F.col("no_pred") | F.col("no_succ")) & F.contains(text, F.lit("s")))
    members = driving.walk(T.tasks_now(spark, folder).where("proj_id IS NOT NULL"), T.links_now(spark, folder), "proj_id").select(F.col("task_id").alias("m_id")).distinct()
    return kept.join(members, F.col("task_id") == F.col("m_id"), "left").select("proj_id", "task_id", F.col("m_id").isNotNull().alias("driving"))


def o9_table_sorts(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's first ten activities by name and by float, up and down: empty and null last either way, ties by id."""
    t = T.tasks_now(spark, folder).where("proj_id IS NOT NULL").withColumn("name", F.nullif(F.trim("task_name"), F.lit("")))
    out = []
    for column in ("name", "total_float_hr_cnt"):
        for way, order in (("up", F.asc_nulls_last(column)), ("down", F.desc_nulls_last(column))):
            place = F.row_number().over(Window.partitionBy("proj_id").orderBy(order, "task_id"))
            out.append(t.withColumn("place", place).where("place <= 10").select("proj_id", F.lit(column).alias("column"), F.lit(way).alias("way"), "place", "task_id"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def o10_window_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 11 to 20 of each project's activities in id order: the slice a scrolled table shows."""
    place = F.row_number().over(Window.partitionBy("proj_id").orderBy("task_id"))
    return T.tasks_now(spark, folder).where("proj_id IS NOT NULL").withColumn("place", place).where("place BETWEEN 11 AND 20").select("proj_id", "place", "task_id")


def a23_type_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A project's activity types in one line, most first, then by label."""
    n = stats.value_mix(T.tasks_now(spark, folder).where("proj_id IS NOT NULL AND task_type IS NOT NULL"), ["proj_id"], "task_type", "label")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "label")))
    return n.groupBy("proj_id").agg(F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", (-p["minus"]).cast("string"), p["label"])), ", ").alias("summary"))


# ---------------------------------------------------------------- pages and lookups


def _page(spark: SparkSession, folder: str, q: cat.ShelfQuery) -> DataFrame:
    return cat.shelf_page(S.programmes(spark, folder), table(spark, folder, "revision"), q)


def f3_owner_shelf(spark: SparkSession, folder: str) -> DataFrame:
    """The shelf of the owner of most listed programmes, the first by id on ties."""
    owner = cat.leaderboard(S.programmes(spark, folder).withColumn("vote_count", F.lit(0)), 1).first()
    return _page(spark, folder, cat.ShelfQuery(owner=owner[0] if owner else "")).select("programme_id", "total_count")


def f6_version_shelf(spark: SparkSession, folder: str) -> DataFrame:
    """The shelf of two versions, largest first, programmes without a size last."""
    return _page(spark, folder, cat.ShelfQuery(versions=("8.3", "7.0"), sort="size")).select("programme_id", "activity_count", "p6_version", "total_count")


def f22_shelf_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of the first shelf page's rows, newest first."""
    return _page(spark, folder, cat.ShelfQuery()).select(
        "programme_id", "slug", "title", "description", "sector", "owner_user_id", "vote_count", "created_at", "parent_programme_id", "parent_title", "revision_id", "rev_no", "p6_version",
        "activity_count", cat.size_band(F.col("activity_count")).alias("size_band"), "pct_complete", "checks_passed", "checks_applicable", "uploaded_at", "total_count",
    )


def o5_has_next(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of programmes by one row of lookahead: 25 rows, and whether a 26th follows."""
    rows = S.programmes(spark, folder).orderBy(F.desc("created_at"), F.desc("id")).offset(cat.PAGE).limit(cat.PAGE + 1).select("id", "created_at")
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))  # of 26 rows at most
    numbered = rows.withColumn("place", place)
    more = numbered.agg((F.max("place") > cat.PAGE).alias("has_next"))
    return numbered.where(F.col("place") <= cat.PAGE).join(F.broadcast(more)).select("id", "place", "has_next")


def o11_failed_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The ten failed revisions that have waited longest: a batch with an order, so a retry takes the same."""
    return table(spark, folder, "revision").where("failure_reason IS NOT NULL").orderBy(F.asc_nulls_last("uploaded_at"), "id").limit(10).select("id", "uploaded_at")


def o12_page_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each sector's shelf: at least one."""
    shelf = cat.published(S.programmes(spark, folder), table(spark, folder, "revision")).where("sector IS NOT NULL").groupBy("sector").agg(F.count("*").alias("n"))
    codes = spark.createDataFrame([(s,) for s in cat.SECTORS], "code string")
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(codes).join(shelf, F.col("code") == F.col("sector"), "left").select(F.col("code").alias("sector"), n.alias("n"), F.greatest(F.ceil(n / cat.PAGE), F.lit(1)).cast("bigint").alias("pages"))


def j3_programme_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Programmes with their current revision, their parent, and the parent's current revision, where there are any."""
    p, r = S.programmes(spark, folder), table(spark, folder, "revision").select("id", "rev_no")
    rev = lambda n: r.select(F.col("id").alias(f"{n}_id"), F.col("rev_no").alias(f"{n}_rev_no"))
    parent = p.select(F.col("id").alias("q_id"), F.col("title").alias("parent_title"), F.col("current_revision_id").alias("q_current"))
    out = p.join(rev("own"), F.col("current_revision_id") == F.col("own_id"), "left").join(parent, F.col("parent_programme_id") == F.col("q_id"), "left")
    return out.join(rev("parent"), F.col("q_current") == F.col("parent_id"), "left").select("id", F.col("own_rev_no").alias("rev_no"), "parent_title", "parent_rev_no")


def l2_revision_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The five newest revisions of each programme, removed ones too, in order."""
    order = Window.partitionBy("programme_id").orderBy(F.desc("rev_no"), F.desc("id"))
    r = table(spark, folder, "revision").where("programme_id IS NOT NULL").withColumn("place", F.row_number().over(order)).where("place <= 5")
    return r.select("programme_id", "place", "id", "rev_no", F.col("removed_at").isNotNull().alias("removed"))


def l3_contributors(spark: SparkSession, folder: str) -> DataFrame:
    """Each owner's listed programmes: how many, votes in all, the newest one."""
    listed = S.programmes(spark, folder).where("status = 'published' AND current_revision_id IS NOT NULL AND owner_user_id IS NOT NULL")
    newest = F.max(F.struct("created_at", "id"))["id"]
    return listed.groupBy("owner_user_id").agg(F.count("*").alias("n"), F.sum("vote_count").alias("votes"), newest.alias("newest_id"))


def a25_relaxed_request(spark: SparkSession, folder: str) -> DataFrame:
    """What the request would find with one chosen facet widened to any of its values, and without it."""
    counts = cat.facet_counts(S.programmes(spark, folder), table(spark, folder, "revision"), S.REQUEST)
    chosen = ((F.col("facet") == "sector") & F.col("value").isin(*S.REQUEST.sectors)) | ((F.col("facet") == "size") & F.col("value").isin(*S.REQUEST.sizes))
    return counts.where("facet IN ('sector', 'size')").groupBy("facet").agg(
        F.sum(F.when(chosen, F.col("n")).otherwise(0)).alias("n_chosen"), F.sum("n").alias("n_without"), F.count_if(~chosen & (F.col("n") > 0)).alias("n_other_values")
    )


def x2_display(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions' display forms: shares, plurals, dates, places on a bar."""
    r = table(spark, folder, "revision")
    n, share = F.col("activity_count"), F.col("pct_complete")
    return r.where("activity_count IS NOT NULL").select(
        "id", formats.percent_text(share).alias("share_text"), formats.plural(n, "activity", "activities").alias("count_text"), formats.clamp_pct(share).alias("bar"),
        F.date_format("start_date", "d MMM yyyy").alias("start_text"), F.year("finish_date").alias("year"), (F.floor(formats.interpolate(n, 0, 5000, 4, 40) * 100 + 0.5) / 100).alias("dot"),
        (F.floor(formats.vote_magnitude(n) * 1e6 + 0.5) / 1e6).alias("magnitude"), formats.hours_as_days(n * 3, 8.0).alias("days"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        g9_path_details, g12_trace_issues, g13_float_marks, g19_fork_cascade, g15_first_level, g16_wbs_tree, f14_table_filters, o9_table_sorts, o10_window_slice, a23_type_summary, f3_owner_shelf,
        f6_version_shelf, f22_shelf_rows, o5_has_next, o11_failed_batch, o12_page_counts, j3_programme_pages, l2_revision_lists, l3_contributors, a25_relaxed_request, x2_display,
    )
}

_DETAILS_SQL = f"""{T._MEMBERS_SQL}, mem AS (SELECT DISTINCT proj_id, task_id FROM member),
  step AS (SELECT DISTINCT e.proj_id, e.succ_id, e.pred_id FROM edge e JOIN mem m ON m.proj_id = e.proj_id AND m.task_id = e.succ_id),
  reach AS (SELECT proj_id, succ_id AS a, pred_id AS b FROM step UNION SELECT r.proj_id, r.a, s.pred_id FROM reach r JOIN step s ON s.proj_id = r.proj_id AND s.succ_id = r.b),
  data AS (SELECT proj_id, CAST({T._MIN.format(c="last_recalc_date")} AS BIGINT) AS dd FROM (SELECT *, row_number() OVER (PARTITION BY proj_id ORDER BY loaded_at DESC) AS rn FROM project) WHERE rn = 1),
  fact AS (SELECT m.proj_id, m.task_id, (SELECT count(*) FROM step s WHERE s.proj_id = m.proj_id AND s.succ_id = m.task_id) AS n_drivers, x.status_code = 'TK_Active' OR coalesce(x.es <= d.dd, false)
      OR EXISTS (SELECT 1 FROM link_now l JOIN side p ON p.task_id = l.pred_id WHERE l.succ_id = m.task_id AND p.status_code = 'TK_Complete') AS grounded,
      EXISTS (SELECT 1 FROM link_now l WHERE l.succ_id = m.task_id AND l.pred_id IS NOT NULL AND l.pred_id NOT IN (SELECT task_id FROM side)) AS open_link
    FROM mem m JOIN side x ON x.task_id = m.task_id LEFT JOIN data d ON d.proj_id = x.proj_id),
  walk AS (SELECT proj_id, count(*) AS n_members, count_if(n_drivers > 1) AS n_branches, count_if(n_drivers = 0) AS n_tails, count_if(n_drivers = 0 AND NOT grounded) AS n_ungrounded, bool_or(open_link) AS truncated FROM fact GROUP BY 1),
  own AS (SELECT t.proj_id, count_if(upper(trim(driving_path_flag)) = 'Y') AS n_flagged, count_if(upper(trim(driving_path_flag)) = 'Y' AND m.task_id IS NOT NULL) AS n_agreed,
      count_if(upper(trim(driving_path_flag)) = 'Y' AND status_code <> 'TK_Complete') AS n_flagged_remaining, min(try_cast(left(early_start_date, 10) AS DATE)) FILTER (m.task_id IS NOT NULL) AS a, max(try_cast(left(early_end_date, 10) AS DATE)) FILTER (m.task_id IS NOT NULL) AS b
    FROM task_now t LEFT JOIN mem m ON m.proj_id = t.proj_id AND m.task_id = t.task_id WHERE t.proj_id IS NOT NULL GROUP BY 1),
  detail AS (SELECT o.proj_id, coalesce(n_members, 0) AS n_members, coalesce(n_branches, 0) AS n_branches, coalesce(n_tails, 0) AS n_tails, coalesce(n_ungrounded, 0) AS n_ungrounded, coalesce(truncated, false) AS truncated,
      o.proj_id IN (SELECT proj_id FROM reach WHERE a = b) AS has_loop, n_flagged, n_agreed, n_flagged_remaining, CAST(b - a + 1 AS INTEGER) AS calendar_days FROM own o LEFT JOIN walk w ON w.proj_id = o.proj_id)"""
#: The latest WBS rows, each node's ancestors, and those clear of loops.
_WBS_PARTS = """wbs AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY wbs_id ORDER BY loaded_at DESC) AS rn FROM projwbs) WHERE rn = 1),
  up AS (SELECT wbs_id AS id, wbs_id AS cur, parent_wbs_id AS parent, [wbs_id] AS seen, false AS looped FROM wbs
    UNION ALL SELECT u.id, s.wbs_id, s.parent_wbs_id, list_append(u.seen, s.wbs_id), list_contains(u.seen, s.wbs_id) FROM up u JOIN wbs s ON s.wbs_id = u.parent WHERE NOT u.looped),
  bad AS (SELECT DISTINCT id FROM up WHERE looped), clear AS (SELECT * FROM up WHERE id NOT IN (SELECT id FROM bad))"""
_WBS_SQL = f"""WITH RECURSIVE {T.TASKS_SQL}, {_WBS_PARTS},
  n AS (SELECT wbs_id, count(*) AS n FROM task_now WHERE wbs_id IS NOT NULL GROUP BY 1),
  sums AS (SELECT w.wbs_id, coalesce(max(o.n), 0) AS own, coalesce(sum(n.n), max(o.n), 0) AS total, (SELECT max(len(seen)) - 1 FROM clear WHERE id = w.wbs_id) AS depth
    FROM wbs w LEFT JOIN n o ON o.wbs_id = w.wbs_id LEFT JOIN clear c ON c.cur = w.wbs_id LEFT JOIN n ON n.wbs_id = c.id GROUP BY 1)"""


def _sorted(column: str, way: str) -> str:
    return f"SELECT proj_id, '{column}' AS \"column\", '{way}' AS way, row_number() OVER (PARTITION BY proj_id ORDER BY {column} {'ASC' if way == 'up' else 'DESC'} NULLS LAST, task_id) AS place, task_id FROM t"


ORACLES = {
    "g9_path_details": f"""{_DETAILS_SQL} SELECT *, NOT has_loop AND NOT truncated AND n_ungrounded = 0 AND n_members > 0 AS path_continuous FROM detail""",
    "g12_trace_issues": f"""{_DETAILS_SQL} SELECT proj_id, 'error' AS severity, 'loop' AS reason FROM detail WHERE has_loop UNION ALL SELECT proj_id, 'info', 'truncated' FROM detail WHERE truncated
UNION ALL SELECT proj_id, 'info', 'flag_differs' FROM detail WHERE n_flagged > 0 AND (n_flagged > n_agreed OR n_members > n_agreed)""",
    "g13_float_marks": f"WITH {T.TASKS_SQL} SELECT proj_id, task_id FROM task_now WHERE total_float_hr_cnt <= 0",
    "g19_fork_cascade": """WITH RECURSIVE p AS (SELECT DISTINCT id, parent_programme_id AS parent FROM programme), w AS (SELECT id, id AS cur, parent, [id] AS seen, false AS looped FROM p
    UNION ALL SELECT w.id, s.id, s.parent, list_append(w.seen, s.id), list_contains(w.seen, s.id) FROM w JOIN p s ON s.id = w.parent WHERE NOT w.looped),
  bad AS (SELECT DISTINCT programme_id FROM revision WHERE removal_class IS NOT NULL), looped AS (SELECT DISTINCT id FROM w WHERE looped)
SELECT id AS programme_id, CAST(min(len(seen) - 1) AS INTEGER) AS distance FROM w WHERE cur IN (SELECT programme_id FROM bad) AND (len(seen) = 1 OR id NOT IN (SELECT id FROM looped)) GROUP BY 1""",
    "g15_first_level": f"""{_WBS_SQL}, f AS (SELECT w.proj_id, w.wbs_id, coalesce(nullif(w.wbs_name, ''), w.wbs_short_name) AS name, s.total AS activity_count FROM wbs w JOIN sums s ON s.wbs_id = w.wbs_id LEFT JOIN wbs q ON q.wbs_id = w.parent_wbs_id
    WHERE coalesce(w.proj_node_flag, '') <> 'Y' AND w.proj_id IS NOT NULL AND (q.wbs_id IS NULL OR q.proj_node_flag = 'Y')),
  r AS (SELECT *, row_number() OVER (PARTITION BY proj_id ORDER BY activity_count DESC, wbs_id) AS place, count(*) OVER (PARTITION BY proj_id) > 20 AS truncated FROM f)
SELECT proj_id, wbs_id, name, activity_count, place, truncated FROM r WHERE place <= 20""",
    "g14_tree_depth": f"{_WBS_SQL} SELECT proj_id, count(*) AS n_nodes, max(depth) AS max_depth FROM wbs JOIN sums USING (wbs_id) WHERE proj_id IS NOT NULL GROUP BY 1",
    "g15_subtree_counts": f"{_WBS_SQL} SELECT wbs_id, own AS n_own, total AS n_subtree FROM sums",
    "g16_wbs_tree": f"{_WBS_SQL} SELECT wbs_id, CAST(depth AS INTEGER) AS depth, own AS n_own, total AS n_subtree FROM sums WHERE wbs_id NOT IN (SELECT id FROM bad)",
    "f14_table_filters": f"""{T._MEMBERS_SQL}, {_WBS_PARTS}, top AS (SELECT id, arg_max(cur, len(seen)) AS root FROM clear GROUP BY 1),
  wanted AS (SELECT w.proj_id, min(w.wbs_id) AS root FROM wbs w JOIN top t ON t.id = w.wbs_id AND t.root = w.wbs_id WHERE w.proj_id IS NOT NULL GROUP BY 1)
SELECT x.proj_id, x.task_id, x.task_id IN (SELECT task_id FROM member) AS driving FROM task_now x JOIN top t ON t.id = x.wbs_id WHERE x.proj_id IS NOT NULL AND t.root IN (SELECT root FROM wanted) AND x.status_code <> 'TK_Complete'
  AND (x.task_id NOT IN (SELECT succ_id FROM link_now WHERE succ_id IS NOT NULL) OR x.task_id NOT IN (SELECT pred_id FROM link_now WHERE pred_id IS NOT NULL)) AND contains(lower(concat_ws(' ', task_code, task_name)), 's')""",
    "o9_table_sorts": f"""WITH {T.TASKS_SQL}, t AS (SELECT proj_id, task_id, nullif(trim(task_name, ' '), '') AS name, total_float_hr_cnt FROM task_now WHERE proj_id IS NOT NULL),
  s AS ({" UNION ALL ".join(_sorted(c, w) for c in ("name", "total_float_hr_cnt") for w in ("up", "down"))}) SELECT * FROM s WHERE place <= 10""",
    "o10_window_slice": f"WITH {T.TASKS_SQL}, s AS (SELECT proj_id, row_number() OVER (PARTITION BY proj_id ORDER BY task_id) AS place, task_id FROM task_now WHERE proj_id IS NOT NULL) SELECT * FROM s WHERE place BETWEEN 11 AND 20",
    "a23_type_summary": f"WITH {T.TASKS_SQL}, n AS (SELECT proj_id, task_type, count(*) AS n FROM task_now WHERE proj_id IS NOT NULL AND task_type IS NOT NULL GROUP BY 1, 2) SELECT proj_id, string_agg(n || ' ' || task_type, ', ' ORDER BY n DESC, task_type) AS summary FROM n GROUP BY 1",
    "f3_owner_shelf": f"""WITH {S._SHELF}, o AS (SELECT owner_user_id FROM p WHERE status = 'published' AND current_revision_id IS NOT NULL AND owner_user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), x AS (SELECT * FROM shelf WHERE owner_user_id IN (SELECT * FROM o))
SELECT programme_id, (SELECT count(*) FROM x) AS total_count FROM x ORDER BY created_at DESC, programme_id DESC LIMIT 25""",
    "f6_version_shelf": f"""WITH {S._SHELF}, x AS (SELECT * FROM shelf WHERE p6_version IN ('8.3', '7.0')) SELECT programme_id, activity_count, p6_version, (SELECT count(*) FROM x) AS total_count FROM x
ORDER BY activity_count DESC NULLS LAST, created_at DESC, programme_id DESC LIMIT 25""",
    "f22_shelf_rows": f"""WITH {S._SHELF}, y AS (SELECT * FROM shelf ORDER BY created_at DESC, programme_id DESC LIMIT 25)
SELECT y.programme_id, p.slug, y.title, y.description, y.sector, y.owner_user_id, y.vote_count, y.created_at, y.parent_programme_id, q.title AS parent_title, r.id AS revision_id, r.rev_no, y.p6_version, y.activity_count, band AS size_band,
  y.pct_complete, y.checks_passed, y.checks_applicable, r.uploaded_at, (SELECT count(*) FROM shelf) AS total_count FROM y JOIN p ON p.id = y.programme_id JOIN revision r ON r.id = p.current_revision_id LEFT JOIN p q ON q.id = y.parent_programme_id""",
    "o5_has_next": f"WITH {S._P}, r AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) - 25 AS place FROM p) SELECT id, place, (SELECT count(*) FROM p) > 50 AS has_next FROM r WHERE place BETWEEN 1 AND 25",
    "o11_failed_batch": "SELECT id, uploaded_at FROM revision WHERE failure_reason IS NOT NULL ORDER BY uploaded_at NULLS LAST, id LIMIT 10",
    "o12_page_counts": f"WITH {S._SHELF}, c AS (SELECT unnest(['rail', 'highways', 'aviation', 'marine', 'building', 'water', 'power', 'process']) AS sector) SELECT c.sector, count(programme_id) AS n, CAST(greatest(ceil(count(programme_id) / 25), 1) AS BIGINT) AS pages FROM c LEFT JOIN shelf USING (sector) GROUP BY 1",
    "j3_programme_pages": f"WITH {S._P} SELECT p.id, r.rev_no, q.title AS parent_title, z.rev_no AS parent_rev_no FROM p LEFT JOIN revision r ON r.id = p.current_revision_id LEFT JOIN p q ON q.id = p.parent_programme_id LEFT JOIN revision z ON z.id = q.current_revision_id",
    "l2_revision_lists": "WITH r AS (SELECT programme_id, row_number() OVER (PARTITION BY programme_id ORDER BY rev_no DESC, id DESC) AS place, id, rev_no, removed_at IS NOT NULL AS removed FROM revision WHERE programme_id IS NOT NULL) SELECT * FROM r WHERE place <= 5",
    "l3_contributors": f"WITH {S._P} SELECT owner_user_id, count(*) AS n, CAST(sum(vote_count) AS BIGINT) AS votes, arg_max(id, (created_at, id)) AS newest_id FROM p WHERE status = 'published' AND current_revision_id IS NOT NULL AND owner_user_id IS NOT NULL GROUP BY 1",
    "a25_relaxed_request": f"""WITH {S._SHELF}, v AS (SELECT 'sector' AS facet, sector AS value, sector IN ('rail', 'marine', 'building') AS chosen FROM shelf WHERE {S._SIZ} AND {S._PRO} AND sector IS NOT NULL
    UNION ALL SELECT 'size', band, band IN ('s', 'm', 'l') FROM shelf WHERE {S._SEC} AND {S._PRO} AND band IS NOT NULL)
SELECT facet, count_if(chosen) AS n_chosen, count(*) AS n_without, count(DISTINCT value) FILTER (NOT chosen) AS n_other_values FROM v GROUP BY 1""",
    "x2_display": """SELECT id, CASE WHEN pct_complete IS NOT NULL THEN CASE WHEN pct_complete = floor(pct_complete) THEN CAST(CAST(pct_complete AS BIGINT) AS VARCHAR) ELSE format('{:.1f}', floor(pct_complete * 10 + 0.5) / 10) END || '%' END AS share_text,
  format('{:,}', activity_count) || CASE WHEN activity_count = 1 THEN ' activity' ELSE ' activities' END AS count_text, least(greatest(pct_complete, 0), 100) AS bar, strftime(start_date, '%-d %b %Y') AS start_text, year(finish_date) AS year,
  floor((4 + (40 - 4) * least(greatest(activity_count / 5000.0::DOUBLE, 0), 1)) * 100 + 0.5) / 100 AS dot, floor(least(sqrt(greatest(activity_count, 0)) / 20, 1) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS magnitude, floor(activity_count * 3 / 8.0::DOUBLE * 10 + 0.5) / 10 AS days
FROM revision WHERE activity_count IS NOT NULL""",
}
