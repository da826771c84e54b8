"""Queries over the display expressions and histogram roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.functions import formats
from schedlake.operators import stats
from schedlake.plans import tasks as T
from schedlake.plans.shelf import NOW
from schedlake.sources.tables import table


def c18_age_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Events per age bucket, seen from a fixed clock."""
    bucket = formats.age_bucket(F.col("ts"), F.lit(NOW).cast("timestamp"))
    return table(spark, folder, "events").groupBy(bucket.alias("age")).agg(F.count("*").alias("n"))


def c17_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    """How far each project's data date stands in its window."""
    span = stats.window_span(T.tasks_now(spark, folder), ["proj_id"]).join(T.data_days(spark, folder), "proj_id")
    share = formats.elapsed_share(F.col("window_start"), F.col("window_finish"), F.col("data_day"))
    return span.select("proj_id", (F.floor(share * 1e6 + 0.5) / 1e6).alias("elapsed"))


def a26_band_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The float histogram rolled up into below 0, 0 to 44 days, and above, with shares."""
    h = T.a13_float_histogram(spark, folder).where("bucket IS NOT NULL")
    band = F.when(F.col("bucket") <= 1, "negative").when(F.col("bucket") <= 5, "ok").otherwise("high")
    rolled = h.groupBy("proj_id", band.alias("band")).agg(F.sum("n").alias("n"))
    total = h.groupBy("proj_id").agg(F.sum("n").alias("total"))
    return rolled.join(total, "proj_id").select("proj_id", "band", "n", (F.floor(F.col("n") / F.col("total") * 1000 + 0.5) / 10).alias("share_pct"))


def x1_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Display forms of revisions' counts."""
    r = table(spark, folder, "revision").where("activity_count IS NOT NULL")
    return r.select(
        "id", formats.format_count(F.col("activity_count")).alias("count_text"), formats.activity_track(F.col("activity_count")).cast("bigint").alias("track"),
        formats.format_bytes(F.col("activity_count") * 1600).alias("size_text"), formats.nice_step(F.col("activity_count")).alias("step"),
    )


QUERIES = {f.__name__: f for f in (c17_elapsed, c18_age_buckets, a26_band_shares, x1_formats)}

ORACLES = {
    "x1_formats": """WITH r AS (SELECT id, activity_count AS n, activity_count * 1600 AS b, activity_count / 5.0::DOUBLE AS raw FROM revision WHERE activity_count IS NOT NULL), p AS (SELECT *, CASE WHEN n > 0 THEN power(10.0::DOUBLE, floor(log10(raw))) END AS power FROM r)
SELECT id, format('{:,}', n) AS count_text, CAST(least(ceil(n / 1000), 10) AS BIGINT) AS track, CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN CAST(floor(b / 1000 + 0.5) AS BIGINT) || ' kB' ELSE format('{:.1f}', floor(b / 100000 + 0.5) / 10) || ' MB' END AS size_text,
  CASE WHEN n > 0 THEN CASE WHEN raw / power <= 1 THEN 1 WHEN raw / power <= 2 THEN 2 WHEN raw / power <= 5 THEN 5 ELSE 10 END * power ELSE 1 END AS step FROM p""",
    "c18_age_buckets": f"""WITH h AS (SELECT (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 3600 AS h FROM events)
SELECT CASE WHEN h < 1 THEN 'new' WHEN h < 48 THEN 'h' WHEN h < 1440 THEN 'd' WHEN h < 17280 THEN 'mo' ELSE 'y' END AS age, count(*) AS n FROM h GROUP BY 1""",
    "c17_elapsed": f"""WITH {T.TASKS_SQL}, {T.DAYS_SQL}, s AS (SELECT proj_id, min({T._START}) AS a, max({T._FINISH}) AS b FROM task_now GROUP BY 1)
SELECT s.proj_id, CASE WHEN b > a THEN floor(least(greatest(CAST(data_day - a AS DOUBLE) / (b - a), 0), 1) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE END AS elapsed FROM s JOIN day_now d ON d.proj_id = s.proj_id""",
    "a26_band_shares": f"""WITH {T.TASKS_SQL}, {T.CAL_SQL}, b AS (SELECT t.proj_id, CASE WHEN total_float_hr_cnt < 0 THEN 'negative' WHEN total_float_hr_cnt / coalesce(h, 8) < 44 THEN 'ok' ELSE 'high' END AS band FROM task_now t LEFT JOIN hpd z ON z.proj_id = t.proj_id WHERE total_float_hr_cnt IS NOT NULL),
  c AS (SELECT proj_id, band, count(*) AS n FROM b GROUP BY 1, 2)
SELECT proj_id, band, n, floor(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY proj_id) * 1000 + 0.5) / 10 AS share_pct FROM c WHERE proj_id IS NOT NULL""",
}
