"""Reference operators over the catalogue tables: shelf, facets, rankings, lineage, counters, set and text lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlake.functions.text import search_match, slugify, tokens
from schedlake.operators import catalogue as cat
from schedlake.operators import hierarchy
from schedlake.sources.tables import table

#: Fixed clock of the time-window queries.
NOW = "2024-01-31 00:00:00"
#: The shelf request that the page and facet queries answer.
REQUEST = cat.ShelfQuery(sectors=("rail", "marine", "building"), sizes=("s", "m", "l"), progressed=True, sort="votes", page=1)
_SEARCH = '"schedule of" rail or bypass -depot'


def programmes(spark: SparkSession, folder: str) -> DataFrame:
    """Each programme once; repeated rows are equal."""
    return hierarchy.latest_rows(table(spark, folder, "programme"), "id", "created_at")


def j1_shelf_page(spark: SparkSession, folder: str) -> DataFrame:
    """One shelf page: inner join to the current revision, left self-join to the parent, total."""
    page = cat.shelf_page(programmes(spark, folder), table(spark, folder, "revision"), REQUEST)
    return page.select("programme_id", "title", "sector", "activity_count", "p6_version", "vote_count", "parent_title", "total_count")


def o4_second_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of everything, newest first."""
    page = cat.shelf_page(programmes(spark, folder), table(spark, folder, "revision"), cat.ShelfQuery(page=2))
    return page.select("programme_id", "created_at", "total_count")


def o2_quality_order(spark: SparkSession, folder: str) -> DataFrame:
    """The best page by share of passed checks, nulls last."""
    page = cat.shelf_page(programmes(spark, folder), table(spark, folder, "revision"), cat.ShelfQuery(sort="quality"))
    return page.select("programme_id", "title", "total_count")


def a8_facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Facet counts under all predicates but their own."""
    return cat.facet_counts(programmes(spark, folder), table(spark, folder, "revision"), REQUEST)


def f5_size_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions by size band; no count, no band."""
    return table(spark, folder, "revision").groupBy(cat.size_band(F.col("activity_count")).alias("band")).agg(F.count("*").alias("n"))


def a9_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Top 100 owners by votes."""
    return cat.leaderboard(programmes(spark, folder))


def w2_owner_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Every owner's rank by votes and programmes, ties sharing a rank."""
    listed = programmes(spark, folder).where("status = 'published' AND current_revision_id IS NOT NULL AND owner_user_id IS NOT NULL")
    grouped = listed.groupBy("owner_user_id").agg(F.sum("vote_count").alias("votes"), F.count("*").alias("n_programmes"))
    return cat.rank_grouped(grouped, [F.desc("votes"), F.desc("n_programmes")], ["votes", "n_programmes"])


def a10_contributors(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct owners of listed programmes."""
    listed = programmes(spark, folder).where("status = 'published' AND current_revision_id IS NOT NULL")
    return listed.agg(F.count_distinct("owner_user_id").alias("n_owners"))


def a11_next_revision(spark: SparkSession, folder: str) -> DataFrame:
    """The next revision number of each programme."""
    return table(spark, folder, "revision").groupBy("programme_id").agg((F.max("rev_no") + 1).alias("next_rev_no"))


def a12_lineage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions, direct forks and same-root programmes of each programme, zero-filled."""
    p = programmes(spark, folder)
    out = cat.filled_counts(p.select("id"), "id", table(spark, folder, "revision"), "programme_id", "n_revisions")
    out = cat.filled_counts(out, "id", p, "parent_programme_id", "n_forks")
    return cat.filled_counts(out, "id", p, "root_programme_id", "n_in_tree")


def w3_latest_revision(spark: SparkSession, folder: str) -> DataFrame:
    """The newest revision of each programme."""
    rows = table(spark, folder, "revision").select("programme_id", "rev_no", "id", "status", "activity_count")
    return cat.latest_per_group(rows, "programme_id", ["rev_no", "id"])


def g18_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Every programme's ancestors with their distance."""
    p = programmes(spark, folder).select("id", F.col("parent_programme_id").alias("parent"))
    return hierarchy.descendants(hierarchy.resolve(p)).select(F.col("descendant").alias("programme_id"), F.col("id").alias("ancestor_id"), F.col("distance").cast("int").alias("distance"))


def j7_flags(spark: SparkSession, folder: str) -> DataFrame:
    """EXISTS flags of each programme: a failed revision, a removed one."""
    r = table(spark, folder, "revision")
    failed = r.where("failure_reason IS NOT NULL").select(F.col("programme_id").alias("f_id")).distinct()
    removed = r.where("removed_at IS NOT NULL").select(F.col("programme_id").alias("r_id")).distinct()
    p = programmes(spark, folder).select("id")
    return p.join(failed, F.col("id") == F.col("f_id"), "left").join(removed, F.col("id") == F.col("r_id"), "left").select("id", F.col("f_id").isNotNull().alias("has_failed"), F.col("r_id").isNotNull().alias("has_removed"))


def j8_orders_without_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without a line: NOT EXISTS as an anti-join."""
    o = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").join(o, "o_orderkey", "left_anti").select("o_orderkey")


def j10_owning_project(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's project: that of its tasks if they name just one, else its first."""
    t = table(spark, folder, "task").where("proj_id IS NOT NULL").groupBy("file_id").agg(F.count_distinct("proj_id").alias("n"), F.min("proj_id").alias("only"))
    p = hierarchy.latest_rows(table(spark, folder, "project"), "proj_id", "loaded_at").select("file_id", "proj_id")
    match = (F.col("n") == 1) & (F.col("proj_id") == F.col("only"))
    best = p.join(t, "file_id", "left").groupBy("file_id").agg(F.min(F.struct((~F.coalesce(match, F.lit(False))).alias("no"), "proj_id")).alias("x"))
    return best.select("file_id", F.col("x.proj_id").alias("proj_id"))


def k7_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vote counts beside rebuilt event counts: each user's events of one type, zero-filled."""
    e = table(spark, folder, "events")
    users = e.select("user_id").distinct()
    return cat.filled_counts(users, "user_id", e.where("event_type = 'purchase'"), "user_id", "n_purchases")


def s11_hash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Texts held more than once, by SHA-256."""
    return cat.duplicates(table(spark, folder, "documents"), F.sha2("text", 256), "doc_id")


def t2_hash_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Content hashes shared by revisions: how many, the first, and whether one was removed."""
    r = table(spark, folder, "revision").where("content_hash IS NOT NULL")
    g = r.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("file_id").alias("first_file"), F.bool_or(F.col("removal_class").isNotNull()).alias("blocked"))
    return g.where("n > 1")


def t11_upload_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads per uploader and month, months of over one only: the rolling gate as a tumbling window."""
    r = table(spark, folder, "revision").where("uploader_display_name IS NOT NULL AND uploaded_at IS NOT NULL")
    return r.groupBy("uploader_display_name", F.date_format("uploaded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).where("n > 1")


def a24_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Conditional counts over look-back windows from a fixed clock, in one pass."""
    ts, now = F.col("ts"), F.lit(NOW).cast("timestamp_ntz")
    back = lambda hours: (ts > now - F.expr(f"INTERVAL {hours} HOURS")) & (ts <= now)
    e = table(spark, folder, "events").withColumn("ts", ts.cast("timestamp_ntz"))
    return e.groupBy("event_type").agg(F.count_if(back(24)).alias("n_24h"), F.count_if(back(72)).alias("n_72h"), F.max("ts").alias("last_ts"))


def t8_alarm_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which an event type's burst alarm turns on or off, against the day before."""
    e = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    # One row a type and day: the window holds as many rows as there are days.
    mean = F.avg("n").over(Window.partitionBy("event_type"))
    on = e.withColumn("alarm", F.col("n") > mean)
    before = F.coalesce(F.lag("alarm").over(Window.partitionBy("event_type").orderBy("day")), F.lit(False))
    return on.withColumn("was", before).where("alarm <> was").select("event_type", "day", "n", "alarm")


def t9_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Late edits over a snapshot: each user's latest event type where there is one since, else the first day's."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    pick = F.max(F.struct("ts", "event_id", "event_type"))["event_type"]
    old = e.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy("user_id").agg(pick.alias("snapshot"))
    new = e.where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy("user_id").agg(pick.alias("edit"))
    return old.join(new, "user_id", "full").select("user_id", F.coalesce("edit", "snapshot").alias("state"), F.col("edit").isNotNull().alias("edited"))


def f8_search(spark: SparkSession, folder: str) -> DataFrame:
    """Programmes that match a web-style search of title and description."""
    words = F.concat(tokens(F.col("title")), tokens(F.col("description")))
    return programmes(spark, folder).where(search_match(words, _SEARCH)).select("id", "title")


def o7_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Did you mean: the five titles most like a misspelt one."""
    return cat.suggestions(programmes(spark, folder), "Nrth Corvane bypas 50").select("id", "title", (F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6).alias("similarity"))


def f9_trigram_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Titles like a query by trigrams, all of them."""
    hit = cat.suggestions(programmes(spark, folder), "lindrake depot", 0.3, 2**31 - 1)
    return hit.select("id")


def f10_equal_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles equal but for case."""
    return programmes(spark, folder).groupBy(F.lower("title").alias("title")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def o9_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    """The ten tasks of most float, nulls and ties last by id: a top-k, not a sort of all rows."""
    t = hierarchy.latest_rows(table(spark, folder, "task"), "task_id", "loaded_at")
    return t.orderBy(F.desc_nulls_last("total_float_hr_cnt"), "task_id").limit(10).select("task_id", "total_float_hr_cnt")


def k8_sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """Listed programmes with their newest upload."""
    p = programmes(spark, folder).where("status = 'published' AND current_revision_id IS NOT NULL").select("id", "slug")
    r = table(spark, folder, "revision").groupBy(F.col("programme_id").alias("id")).agg(F.max("uploaded_at").alias("last_upload"))
    return p.join(r, "id")


def f14_activity_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The activity table's filters together: status, float at or below 0, name substring."""
    t = hierarchy.latest_rows(table(spark, folder, "task"), "task_id", "loaded_at").where("deleted_at IS NULL")
    text = F.lower(F.concat_ws(" ", "task_code", "task_name"))
    return t.where((F.col("status_code") != "TK_Complete") & (F.col("total_float_hr_cnt") <= 0) & F.contains(text, F.lit("slab"))).select("task_id", "task_code", "total_float_hr_cnt")


def s8_open_enums(spark: SparkSession, folder: str) -> DataFrame:
    """Values outside the known lists of the open enumerations."""
    known = {
        "task_type": ["TT_Task", "TT_Rsrc", "TT_LOE", "TT_Mile", "TT_FinMile", "TT_WBS"],
        "status_code": ["TK_NotStart", "TK_Active", "TK_Complete"],
        "pred_type": ["PR_FS", "PR_SS", "PR_FF", "PR_SF"],
    }
    t, r = table(spark, folder, "task"), table(spark, folder, "taskpred")
    pairs = t.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("task_type", "status_code")])).alias("e")).select("e.*")
    pairs = pairs.unionByName(r.select(F.lit("pred_type").alias("field"), F.col("pred_type").alias("value")))
    odd = F.lit(False)
    for name, values in known.items():
        odd = odd | ((F.col("field") == name) & ~F.col("value").isin(values))
    return pairs.where(odd).groupBy("field", "value").agg(F.count("*").alias("n"))


def u3_set_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks that have a predecessor and no successor, by set difference."""
    r = table(spark, folder, "taskpred")
    succ = r.where("task_id IS NOT NULL").select("task_id")
    return succ.distinct().exceptAll(r.where("pred_task_id IS NOT NULL").select(F.col("pred_task_id").alias("task_id")).distinct().intersect(succ))


def f21_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs of titles."""
    return programmes(spark, folder).select("id", slugify(F.col("title")).alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (
        j1_shelf_page, o4_second_page, o2_quality_order, a8_facet_counts, f5_size_bands, a9_leaderboard, w2_owner_ranks, a10_contributors, a11_next_revision,
        a12_lineage_counts, w3_latest_revision, g18_ancestors, j7_flags, j8_orders_without_lines, j10_owning_project, k7_counters, s11_hash_groups, t2_hash_gate,
        t11_upload_bursts, a24_window_counts, t8_alarm_changes, t9_merge, f8_search, o7_suggestions, f9_trigram_matches, f10_equal_titles, o9_nulls_last,
        k8_sitemap, f14_activity_filter, s8_open_enums, u3_set_difference, f21_slugs,
    )
}

_P = "p AS (SELECT DISTINCT * FROM programme)"
_SHELF = f"""{_P}, shelf AS (SELECT p.id AS programme_id, p.title, p.description, p.sector, p.owner_user_id, p.vote_count, p.created_at, p.parent_programme_id, r.activity_count, r.p6_version,
    r.pct_complete, r.checks_passed, r.checks_applicable, CASE WHEN activity_count BETWEEN 0 AND 499 THEN 's' WHEN activity_count BETWEEN 500 AND 1999 THEN 'm'
      WHEN activity_count BETWEEN 2000 AND 5000 THEN 'l' WHEN activity_count >= 5001 THEN 'xl' END AS band
  FROM p JOIN revision r ON r.id = p.current_revision_id WHERE p.status = 'published' AND r.status = 'published')"""
_SEC, _SIZ, _PRO = "sector IN ('rail', 'marine', 'building')", "band IN ('s', 'm', 'l')", "pct_complete > 0"
_TRI = """list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN [x FOR x IN string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') IF x <> '']]))"""


def _similar(query: str) -> str:
    a, b = _TRI.format(t="title"), _TRI.format(t=f"'{query}'")
    return f"""SELECT id, title, len(list_intersect(a, b)) * 1.0::DOUBLE / len(list_distinct(a || b)) AS sim FROM (SELECT id, title, {a} AS a, {b} AS b FROM p)"""


def _facet(name: str, value: str, *others: str) -> str:
    return f"SELECT '{name}' AS facet, {value} AS value FROM shelf WHERE {' AND '.join(others)} AND {value} IS NOT NULL"


ORACLES = {
    "f21_slugs": f"""WITH {_P}, s AS (SELECT id, rtrim(left(trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[''’‘"“”]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-') AS slug FROM p)
SELECT id, CASE WHEN coalesce(slug, '') = '' THEN 'programme' ELSE slug END AS slug FROM s""",
    "j1_shelf_page": f"""WITH {_SHELF}, x AS (SELECT * FROM shelf WHERE {_SEC} AND {_SIZ} AND {_PRO}), y AS (SELECT * FROM x ORDER BY vote_count DESC, created_at DESC, programme_id DESC LIMIT 25)
SELECT programme_id, y.title, y.sector, activity_count, p6_version, y.vote_count, q.title AS parent_title, (SELECT count(*) FROM x) AS total_count FROM y LEFT JOIN p q ON q.id = y.parent_programme_id""",
    "o4_second_page": f"WITH {_SHELF} SELECT programme_id, created_at, (SELECT count(*) FROM shelf) AS total_count FROM shelf ORDER BY created_at DESC, programme_id DESC LIMIT 25 OFFSET 25",
    "o2_quality_order": f"""WITH {_SHELF} SELECT programme_id, title, (SELECT count(*) FROM shelf) AS total_count FROM shelf
ORDER BY CAST(checks_passed AS DOUBLE) / nullif(CAST(checks_applicable AS DOUBLE), 0) DESC NULLS LAST, checks_applicable DESC NULLS LAST, created_at DESC, programme_id DESC LIMIT 25""",
    "a8_facet_counts": f"""WITH {_SHELF}, v AS ({_facet("sector", "sector", _SIZ, _PRO)} UNION ALL {_facet("size", "band", _SEC, _PRO)} UNION ALL {_facet("version", "p6_version", _SEC, _SIZ, _PRO)}
    UNION ALL {_facet("progressed", "CASE WHEN pct_complete > 0 THEN 'yes' END", _SEC, _SIZ)}),
  k AS (SELECT 'sector' AS facet, unnest(['rail', 'highways', 'aviation', 'marine', 'building', 'water', 'power', 'process']) AS value UNION ALL SELECT 'size', unnest(['s', 'm', 'l', 'xl']) UNION ALL SELECT 'progressed', 'yes'),
  c AS (SELECT facet, value, count(*) AS n FROM v GROUP BY 1, 2) SELECT facet, value, coalesce(n, 0) AS n FROM c FULL JOIN k USING (facet, value)""",
    "f5_size_bands": """SELECT CASE WHEN activity_count BETWEEN 0 AND 499 THEN 's' WHEN activity_count BETWEEN 500 AND 1999 THEN 'm' WHEN activity_count BETWEEN 2000 AND 5000 THEN 'l' WHEN activity_count >= 5001 THEN 'xl' END AS band,
  count(*) AS n FROM revision GROUP BY 1""",
    "a9_leaderboard": f"""WITH {_P} SELECT owner_user_id, CAST(sum(vote_count) AS BIGINT) AS votes, count(*) AS n_programmes FROM p WHERE status = 'published' AND current_revision_id IS NOT NULL AND owner_user_id IS NOT NULL
GROUP BY 1 ORDER BY votes DESC, n_programmes DESC, owner_user_id LIMIT 100""",
    "w2_owner_ranks": f"""WITH {_P}, g AS (SELECT owner_user_id, CAST(sum(vote_count) AS BIGINT) AS votes, count(*) AS n_programmes FROM p WHERE status = 'published' AND current_revision_id IS NOT NULL AND owner_user_id IS NOT NULL GROUP BY 1)
SELECT *, rank() OVER (ORDER BY votes DESC, n_programmes DESC) AS rank FROM g""",
    "a10_contributors": f"WITH {_P} SELECT count(DISTINCT owner_user_id) AS n_owners FROM p WHERE status = 'published' AND current_revision_id IS NOT NULL",
    "a11_next_revision": "SELECT programme_id, max(rev_no) + 1 AS next_rev_no FROM revision GROUP BY 1",
    "a12_lineage_counts": f"""WITH {_P} SELECT id, (SELECT count(*) FROM revision r WHERE r.programme_id = p.id) AS n_revisions, (SELECT count(*) FROM p c WHERE c.parent_programme_id = p.id) AS n_forks,
  (SELECT count(*) FROM p c WHERE c.root_programme_id = p.id) AS n_in_tree FROM p""",
    "w3_latest_revision": "SELECT programme_id, rev_no, id, status, activity_count FROM (SELECT *, row_number() OVER (PARTITION BY programme_id ORDER BY rev_no DESC, id DESC) AS rn FROM revision) WHERE rn = 1",
    "g18_ancestors": f"""WITH RECURSIVE {_P}, w AS (SELECT id, id AS cur, parent_programme_id AS parent, [id] AS seen, false AS looped FROM p
    UNION ALL SELECT w.id, s.id, s.parent_programme_id, list_append(w.seen, s.id), list_contains(w.seen, s.id) FROM w JOIN p s ON s.id = w.parent WHERE NOT w.looped),
  bad AS (SELECT DISTINCT id FROM w WHERE looped)
SELECT id AS programme_id, cur AS ancestor_id, CAST(len(seen) - 1 AS INTEGER) AS distance FROM w WHERE len(seen) > 1 AND id NOT IN (SELECT id FROM bad)""",
    "j7_flags": f"WITH {_P} SELECT id, EXISTS (SELECT 1 FROM revision r WHERE r.programme_id = p.id AND failure_reason IS NOT NULL) AS has_failed, EXISTS (SELECT 1 FROM revision r WHERE r.programme_id = p.id AND removed_at IS NOT NULL) AS has_removed FROM p",
    "j8_orders_without_lines": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "j10_owning_project": """WITH t AS (SELECT file_id, count(DISTINCT proj_id) AS n, min(proj_id) AS o FROM task WHERE proj_id IS NOT NULL GROUP BY 1),
  p AS (SELECT proj_id, max_by(file_id, loaded_at) AS file_id FROM project GROUP BY 1)
SELECT file_id, proj_id FROM (SELECT p.file_id, p.proj_id, row_number() OVER (PARTITION BY p.file_id ORDER BY coalesce(n = 1 AND proj_id = o, false) DESC, proj_id) AS rn FROM p LEFT JOIN t USING (file_id)) WHERE rn = 1""",
    "k7_counters": "SELECT user_id, count_if(event_type = 'purchase') AS n_purchases FROM events GROUP BY 1",
    "s11_hash_groups": "SELECT sha256(text) AS value, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "t2_hash_gate": "SELECT content_hash, count(*) AS n, min(file_id) AS first_file, bool_or(removal_class IS NOT NULL) AS blocked FROM revision WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "t11_upload_bursts": "SELECT uploader_display_name, strftime(uploaded_at, '%Y-%m') AS month, count(*) AS n FROM revision WHERE uploader_display_name IS NOT NULL AND uploaded_at IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "a24_window_counts": f"""SELECT event_type, count_if(ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}') AS n_24h, count_if(ts > TIMESTAMP '{NOW}' - INTERVAL 72 HOUR AND ts <= TIMESTAMP '{NOW}') AS n_72h,
  max(ts) AS last_ts FROM events GROUP BY 1""",
    "t8_alarm_changes": """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), o AS (SELECT *, n > avg(n) OVER (PARTITION BY event_type) AS alarm FROM e),
  w AS (SELECT *, coalesce(lag(alarm) OVER (PARTITION BY event_type ORDER BY day), false) AS was FROM o) SELECT event_type, day, n, alarm FROM w WHERE alarm <> was""",
    "t9_merge": """WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT user_id, coalesce(n.s, o.s) AS state, n.s IS NOT NULL AS edited FROM o FULL JOIN n USING (user_id)""",
    "f8_search": f"""WITH {_P}, w AS (SELECT id, title, ' ' || array_to_string([x FOR x IN string_split(regexp_replace(lower(coalesce(title, '')) || ' ' || lower(coalesce(description, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') IF x <> ''], ' ') || ' ' AS t FROM p)
SELECT id, title FROM w WHERE contains(t, ' schedule of ') AND (contains(t, ' rail ') OR contains(t, ' bypass ')) AND NOT contains(t, ' depot ')""",
    "o7_suggestions": f"WITH {_P} SELECT id, title, floor(sim * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS similarity FROM ({_similar('Nrth Corvane bypas 50')}) WHERE sim > 0.3 ORDER BY sim DESC, title, id LIMIT 5",
    "f9_trigram_matches": f"WITH {_P} SELECT id FROM ({_similar('lindrake depot')}) WHERE sim > 0.3",
    "f10_equal_titles": f"WITH {_P} SELECT lower(title) AS title, count(*) AS n, min(id) AS first_id FROM p GROUP BY 1",
    "o9_nulls_last": """WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY loaded_at DESC) AS rn FROM task) WHERE rn = 1)
SELECT task_id, total_float_hr_cnt FROM t ORDER BY total_float_hr_cnt DESC NULLS LAST, task_id LIMIT 10""",
    "k8_sitemap": f"WITH {_P} SELECT p.id, slug, max(uploaded_at) AS last_upload FROM p JOIN revision r ON r.programme_id = p.id WHERE p.status = 'published' AND current_revision_id IS NOT NULL GROUP BY 1, 2",
    "f14_activity_filter": """WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY loaded_at DESC) AS rn FROM task) WHERE rn = 1 AND deleted_at IS NULL)
SELECT task_id, task_code, total_float_hr_cnt FROM t WHERE status_code <> 'TK_Complete' AND total_float_hr_cnt <= 0 AND contains(lower(concat_ws(' ', task_code, task_name)), 'slab')""",
    "s8_open_enums": """WITH v AS (SELECT 'task_type' AS field, task_type AS value FROM task UNION ALL SELECT 'status_code', status_code FROM task UNION ALL SELECT 'pred_type', pred_type FROM taskpred)
SELECT field, value, count(*) AS n FROM v WHERE (field = 'task_type' AND value NOT IN ('TT_Task', 'TT_Rsrc', 'TT_LOE', 'TT_Mile', 'TT_FinMile', 'TT_WBS')) OR (field = 'status_code' AND value NOT IN ('TK_NotStart', 'TK_Active', 'TK_Complete'))
  OR (field = 'pred_type' AND value NOT IN ('PR_FS', 'PR_SS', 'PR_FF', 'PR_SF')) GROUP BY 1, 2""",
    "u3_set_difference": "SELECT DISTINCT task_id FROM taskpred WHERE task_id IS NOT NULL EXCEPT SELECT pred_task_id FROM taskpred WHERE pred_task_id IS NOT NULL",
}
