"""Schedule statistics per group: mixes, spans, histograms, curves, shares.

Every function takes a task DataFrame and the grouping columns; all are single
aggregations combined before their shuffle, or windows over their small results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.dates import month_index, real_day
from schedlake.functions.numbers import percent

#: Histogram edges in working days; None is an open bound.
FLOAT_EDGES = (None, -20, 0, 5, 10, 20, 44, 100, 200, None)
DURATION_EDGES = (0, 1, 5, 10, 20, 44, 100, 200, None)
#: Months an S-curve may span, points of a card curve, days of high float.
MONTH_CAP, CARD_POINTS, HIGH_DAYS = 1200, 16, 44


def task_start(actual: str = "act_start_date", early: str = "early_start_date", target: str = "target_start_date") -> Column:
    """First non-null of actual, early and target; an unreadable one hides the next."""
    return F.coalesce(actual, early, target)


def task_finish() -> Column:
    return task_start("act_end_date", "early_end_date", "target_end_date")


def value_mix(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows per value of an open enumeration, nulls as a value of their own."""
    return df.groupBy(*keys, F.col(value).alias(name)).agg(F.count("*").alias("n"))


def progress(df: DataFrame, keys: list[str]) -> DataFrame:
    """Activities, complete ones and their percentage, milestones, and whether nothing has started."""
    done = F.count_if(F.col("status_code") == "TK_Complete")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        done.alias("n_complete"),
        percent(done, F.count("*")).alias("pct_complete"),
        F.count_if(F.col("task_type").isin("TT_Mile", "TT_FinMile")).alias("n_milestones"),
        F.coalesce(F.bool_and(F.col("act_start_date").isNull()), F.lit(True)).alias("is_baseline"),
    )


def window_span(df: DataFrame, keys: list[str]) -> DataFrame:
    """First start, last finish and the inclusive days between; unreadable dates do not count."""
    first, last = F.min(real_day(task_start())), F.max(real_day(task_finish()))
    return df.groupBy(*keys).agg(
        first.alias("window_start"), last.alias("window_finish"), (F.datediff(last, first) + 1).alias("calendar_days")
    )


def bucket(value: Column, edges: tuple) -> Column:
    """Number of the first bucket [edge, next edge) that holds the value; below the first edge it is 0."""
    out = None
    for i, upper in enumerate(edges[1:]):
        test = F.lit(True) if upper is None else value < F.lit(float(upper))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.when(value.isNotNull(), out)


def histogram(df: DataFrame, keys: list[str], days: Column, edges: tuple) -> DataFrame:
    """``(keys, bucket, n)``, long form; null values in the bucket null."""
    return df.groupBy(*keys, bucket(days, edges).alias("bucket")).agg(F.count("*").alias("n"))


def float_band(hours: Column, high_hours: Column | float) -> Column:
    """neg below 0, high strictly above the limit, else ok; null for null."""
    return F.when(hours < 0, "neg").when(hours > high_hours, "high").when(hours.isNotNull(), "ok")


def float_mix(df: DataFrame, keys: list[str], hours: str, high_hours: Column | float) -> DataFrame:
    """Whole percentages of the three float bands that sum to 100 (largest remainder).

    Nulls are outside the base; a group without floats has 0 thrice. Leftover points go to the
    largest fractions, ties in the order neg, ok, high.
    """
    band = float_band(F.col(hours), high_hours)
    base = df.groupBy(*keys).agg(*[F.count_if(band == b).alias(b) for b in ("neg", "ok", "high")])
    total = F.col("neg") + F.col("ok") + F.col("high")
    exact = {b: F.when(total > 0, F.col(b) * 100.0 / total).otherwise(0.0) for b in ("neg", "ok", "high")}
    base = base.withColumns({f"{b}_floor": F.floor(x) for b, x in exact.items()} | {f"{b}_frac": x - F.floor(x) for b, x in exact.items()})
    left = F.when(total > 0, 100 - F.col("neg_floor") - F.col("ok_floor") - F.col("high_floor")).otherwise(0)

    def ahead(b: str) -> Column:
        """How many bands take a leftover point before this one."""
        order = ("neg", "ok", "high")
        me = order.index(b)
        return sum(
            (
                F.when((F.col(f"{o}_frac") > F.col(f"{b}_frac")) | ((F.col(f"{o}_frac") == F.col(f"{b}_frac")) & F.lit(i < me)), 1).otherwise(0)
                for i, o in enumerate(order)
                if o != b
            ),
            F.lit(0),
        )

    return base.select(
        *keys, *[(F.col(f"{b}_floor") + F.when(ahead(b) < left, 1).otherwise(0)).cast("bigint").alias(f"{b}_pct") for b in ("neg", "ok", "high")]
    )


def s_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """Starts and finishes a month and the running share of finishes over a dense month grid.

    The grid runs from the window's first to its last month, at most ``MONTH_CAP`` of them;
    dates outside are counted at its ends. Groups without a window have no rows.
    """
    month = lambda text: month_index(real_day(text))
    span = df.groupBy(*keys).agg(F.min(month(task_start())).alias("m0"), F.max(month(task_finish())).alias("m1")).where("m0 IS NOT NULL AND m1 >= m0")
    span = span.withColumn("m1", F.least("m1", F.col("m0") + MONTH_CAP - 1))
    grid = span.select(*keys, "m0", F.explode(F.sequence("m0", "m1")).alias("month"))
    ends = df.select(*keys, F.explode(F.array(F.struct(F.lit("s").alias("k"), month(task_start()).alias("m")), F.struct(F.lit("f").alias("k"), month(task_finish()).alias("m")))).alias("e")).where("e.m IS NOT NULL")
    # Counted per month before they meet the span, so a large group sends one row a month and task.
    ends = ends.groupBy(*keys, F.col("e.m").alias("m")).agg(F.count_if(F.col("e.k") == "s").alias("a"), F.count_if(F.col("e.k") == "f").alias("b"))
    clamped = ends.join(span, keys).withColumn("month", F.least(F.greatest("m", "m0"), "m1"))
    counts = clamped.groupBy(*keys, "month").agg(F.sum("a").alias("starts"), F.sum("b").alias("finishes"))
    dense = grid.join(counts, [*keys, "month"], "left").na.fill(0, ["starts", "finishes"])
    run = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(*keys, (F.col("month") - F.col("m0")).alias("month_no"), "starts", "finishes", F.sum("finishes").over(run).alias("cumulative"))


def card_curve(curve: DataFrame, keys: list[str]) -> DataFrame:
    """An S-curve resampled to 16 points of its final value, zeros where nothing finishes."""
    packed = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("month_no", "cumulative"))).alias("c"))
    n, total = F.size("c"), F.element_at("c", -1)["cumulative"]
    at = lambda i: F.floor(i.cast("double") / (CARD_POINTS - 1) * (n - 1) + 0.5).cast("int")
    points = F.transform(F.sequence(F.lit(0), F.lit(CARD_POINTS - 1)), lambda i: F.struct(i.alias("point"), F.get("c", at(i))["cumulative"].alias("cum")))
    rows = packed.select(*keys, total.alias("total"), F.explode(points).alias("p"))
    return rows.select(*keys, "p.point", F.when(F.col("total") > 0, F.floor(F.col("p.cum") / F.col("total") * 1000 + 0.5) / 1000).otherwise(0.0).alias("value"))


def code_types(assigned: DataFrame, declared: DataFrame, activities: int | Column, limit: int = 50) -> DataFrame:
    """Top code types: assigned share of activities and number of values.

    ``assigned(task, code_type, code)``; ``declared(code_type, n_declared)``; values are the
    declared ones, else the distinct assigned ones.
    """
    used = assigned.groupBy("code_type").agg(F.count_distinct("task").alias("n_tasks"), F.count_distinct("code").alias("n_codes"))
    both = declared.join(used, "code_type", "left")
    n = F.coalesce("n_tasks", F.lit(0))
    whole = F.lit(activities) if isinstance(activities, int) else activities
    out = both.select(
        "code_type", F.when(F.col("n_declared") > 0, F.col("n_declared")).otherwise(F.coalesce("n_codes", F.lit(0))).alias("value_count"), percent(n, whole).alias("assigned_pct")
    )
    return out.orderBy(F.desc("assigned_pct"), F.desc("value_count"), "code_type").limit(limit)
