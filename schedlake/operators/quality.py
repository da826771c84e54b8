"""The 14-point schedule quality scorecard: ten computed checks, four skipped, worst-first exemplars.

One pass over tasks and one over relationships give every numerator and denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.dates import real_day
from schedlake.functions.numbers import percent
from schedlake.operators.stats import HIGH_DAYS

#: Constraint codes that count as hard.
HARD_CONSTRAINTS = ("CS_MANDSTART", "CS_MANDFIN", "CS_MSO", "CS_MEO", "CS_MSOB", "CS_MEOB")
#: Check number and name.
CHECKS = (
    (1, "logic"), (2, "leads"), (3, "lags"), (4, "relationship_types"), (5, "hard_constraints"), (6, "high_float"), (7, "negative_float"),
    (8, "high_duration"), (9, "invalid_dates"), (10, "resources"), (11, "missed_tasks"), (12, "critical_path_test"), (13, "cpli"), (14, "bei"),
)
EXEMPLARS = 50


def invalid_date_reason(data_day: Column) -> Column:
    """Why a task's dates contradict the data date, in whole days; null when they do not."""
    day = lambda c: real_day(F.col(c))
    return (
        F.when(day("act_start_date") > data_day, "actual_start_after")
        .when(day("act_end_date") > data_day, "actual_finish_after")
        .when(F.col("status_code") == "TK_Complete", F.lit(None).cast("string"))
        .when((F.col("status_code") != "TK_Active") & (day("early_start_date") < data_day), "early_start_before")
        .when(day("early_end_date") < data_day, "early_finish_before")
    )


def flagged_tasks(tasks: DataFrame, links: DataFrame, data_days: DataFrame, key: str = "proj_id", hours_per_day: Column | None = None) -> DataFrame:
    """Tasks with one flag a check. ``data_days(key, data_day)`` may lack a group: then check 9 is null.

    ``links(succ_id, pred_id)`` decide open ends; a link counts where it names the task.
    ``hours_per_day`` is a column of ``tasks``, 8 by default.
    """
    preds = links.select(F.col("succ_id").alias("p_id")).where("p_id IS NOT NULL").distinct()
    succs = links.select(F.col("pred_id").alias("s_id")).where("s_id IS NOT NULL").distinct()
    high = F.coalesce(F.lit(8.0) if hours_per_day is None else hours_per_day, F.lit(8.0)) * HIGH_DAYS
    joined = (
        tasks.join(preds, F.col("task_id") == F.col("p_id"), "left")
        .join(succs, F.col("task_id") == F.col("s_id"), "left")
        .join(data_days, key, "left")
    )
    reason = invalid_date_reason(F.col("data_day"))
    return joined.withColumns(
        {
            "no_pred": F.col("p_id").isNull(),
            "no_succ": F.col("s_id").isNull(),
            "hard": F.coalesce(F.col("cstr_type").isin(*HARD_CONSTRAINTS), F.lit(False)),
            "high_float": F.coalesce(F.col("total_float_hr_cnt") > high, F.lit(False)),
            "neg_float": F.coalesce(F.col("total_float_hr_cnt") < 0, F.lit(False)),
            "high_duration": F.coalesce(F.col("target_drtn_hr_cnt") > high, F.lit(False)),
            "invalid": F.when(F.col("data_day").isNotNull(), reason),
        }
    ).drop("p_id", "s_id")


def scorecard(flagged: DataFrame, links: DataFrame, key: str = "proj_id") -> DataFrame:
    """``(key, check_no, check, count, pct, state)``: all 14 checks of every group of tasks.

    A zero denominator skips a check, as does a missing data date check 9; checks 11-14 always
    skip (no baseline, no scheduling engine).
    """
    t = flagged.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if("no_pred").alias("a"), F.count_if("no_succ").alias("b"),
        F.count_if(F.col("no_pred") | F.col("no_succ")).alias("open"), F.count_if("hard").alias("hard"), F.count_if("high_float").alias("hf"),
        F.count_if("neg_float").alias("nf"), F.count_if("high_duration").alias("hd"), F.count("invalid").alias("inv"), F.max("data_day").alias("dd"),
        F.count_if("has_resource").alias("res"),
    )
    r = links.groupBy(key).agg(
        F.count("*").alias("r"), F.count_if(F.col("lag_hr_cnt") < 0).alias("lead"), F.count_if(F.col("lag_hr_cnt") > 0).alias("lag"),
        F.count_if(F.col("pred_type") == "PR_FS").alias("fs"),
    )
    wide = t.join(r, key, "left").na.fill(0, ["r", "lead", "lag", "fs"])
    n, rel = F.col("n"), F.col("r")
    skip = lambda has, ok: F.when(~has, "skip").when(ok, "pass").otherwise("fail")
    none = F.lit(None).cast("double")

    def row(no: int, count: Column, pct: Column, state: Column) -> Column:
        return F.struct(F.lit(no).alias("check_no"), F.lit(dict(CHECKS)[no]).alias("check"), count.cast("bigint").alias("count"), pct.alias("pct"), state.alias("state"))

    share = lambda c, whole: percent(F.col(c), whole)
    worse = F.greatest(share("a", n), share("b", n))
    rows = [
        row(1, F.col("open"), worse, skip(n > 0, worse <= 5)),
        row(2, F.col("lead"), share("lead", rel), skip(rel > 0, F.col("lead") == 0)),
        row(3, F.col("lag"), share("lag", rel), skip(rel > 0, share("lag", rel) <= 5)),
        row(4, rel - F.col("fs"), share("fs", rel), skip(rel > 0, share("fs", rel) >= 90)),
        row(5, F.col("hard"), share("hard", n), skip(n > 0, share("hard", n) <= 5)),
        row(6, F.col("hf"), share("hf", n), skip(n > 0, share("hf", n) <= 5)),
        row(7, F.col("nf"), share("nf", n), skip(n > 0, F.col("nf") == 0)),
        row(8, F.col("hd"), share("hd", n), skip(n > 0, share("hd", n) <= 5)),
        row(9, F.col("inv"), share("inv", n), skip((n > 0) & F.col("dd").isNotNull(), F.col("inv") == 0)),
        row(10, F.col("res"), share("res", n), skip(n > 0, F.lit(True))),
        *[row(i, F.lit(None), none, F.lit("skip")) for i in (11, 12, 13, 14)],
    ]
    return wide.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


def totals(card: DataFrame, key: str = "proj_id") -> DataFrame:
    """Passed, applicable and skipped checks: a skip leaves both sides of the ratio."""
    return card.groupBy(key).agg(
        F.count_if(F.col("state") == "pass").alias("passed"), F.count_if(F.col("state") != "skip").alias("applicable"), F.count_if(F.col("state") == "skip").alias("skipped")
    )


def exemplars(flagged: DataFrame, links: DataFrame | None = None, card: DataFrame | None = None, key: str = "proj_id", limit: int = EXEMPLARS) -> DataFrame:
    """The worst cases of checks 1, 2, 3, 5, 6, 7, 8 and 9, at most ``limit`` a check, stable in task order.

    Cases of checks 2 and 3 are relationships of ``links`` and stand under their successor; without
    ``links`` there are none. With ``card`` only failing checks have cases. Top-k per group:
    the window is limited on each side of its shuffle, so a hot group sends ``limit`` rows a task.
    """
    some = lambda no, test, bad: F.when(test, F.struct(F.lit(no).alias("check_no"), bad.cast("double").alias("badness")))
    cases = F.array(
        some(1, F.col("no_pred") | F.col("no_succ"), F.when(F.col("no_pred") & F.col("no_succ"), 1).otherwise(0)),
        some(5, F.col("hard"), F.lit(0)),
        some(6, F.col("high_float"), F.col("total_float_hr_cnt")),
        some(7, F.col("neg_float"), -F.col("total_float_hr_cnt")),
        some(8, F.col("high_duration"), F.col("target_drtn_hr_cnt")),
        some(9, F.col("invalid").isNotNull(), F.lit(0)),
    )
    none = F.lit(None).cast("bigint")
    rows = flagged.select(key, "task_id", none.alias("pred_id"), F.explode(F.array_compact(cases)).alias("c")).select(key, "task_id", "pred_id", "c.*")
    if links is not None:
        lag = F.col("lag_hr_cnt")
        ends = F.array(some(2, lag < 0, -lag), some(3, lag > 0, lag))
        rows = rows.unionByName(links.where(F.col(key).isNotNull()).select(key, F.col("succ_id").alias("task_id"), "pred_id", F.explode(F.array_compact(ends)).alias("c")).select(key, "task_id", "pred_id", "c.*"))
    if card is not None:
        rows = rows.join(card.where("state = 'fail'").select(key, "check_no"), [key, "check_no"], "left_semi")
    order = Window.partitionBy(key, "check_no").orderBy(F.desc("badness"), "task_id", "pred_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
