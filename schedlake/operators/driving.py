"""The driving path through the logic network: driving links, seeds, backward walk, loops.

Driving links are an argmax join with ties kept. The walk is a depth-first search per group
on those links alone; a group above ``local_limit`` links is walked by a distributed
fixpoint instead, so no group is ever too large for a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.dates import minute_number, real_day
from schedlake.session import cut

#: Links of a group that one task may hold at once, and rows of small groups in a slot.
LOCAL_LIMIT, SLOT_ROWS = 200_000, 100_000


def _kind(task_type: Column, column: str) -> Column:
    """Whether a task's early start or finish stands for a start or a finish."""
    return F.when(task_type == "TT_FinMile", "finish").when(task_type == "TT_Mile", "start").otherwise("finish" if column == "ef" else "start")


def driving_links(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """``(succ_id, pred_id, pred_type, gap)``: per successor its live predecessors of greatest gap.

    gap = what the predecessor demands + lag - the successor's instant, in elapsed minutes. Complete
    predecessors and links with an unreadable instant are no candidates; a link without lag
    that falls short between instants of one kind is dropped. Ties all drive.
    """
    es, ef = minute_number(F.col("early_start_date")), minute_number(F.col("early_end_date"))
    side = tasks.select("task_id", "task_type", "status_code", es.alias("es"), ef.alias("ef"))
    pred = side.select(*[F.col(c).alias(f"p_{c}") for c in side.columns])
    succ = side.select(*[F.col(c).alias(f"s_{c}") for c in side.columns])
    both = links.join(pred, F.col("pred_id") == F.col("p_task_id")).join(succ, F.col("succ_id") == F.col("s_task_id")).where("p_status_code <> 'TK_Complete'")
    t = F.col("pred_type")
    from_start, to_finish = t.isin("PR_SS", "PR_SF"), t.isin("PR_FF", "PR_SF")
    demand = F.when(from_start, F.col("p_es")).otherwise(F.col("p_ef"))
    reference = F.when(to_finish, F.col("s_ef")).otherwise(F.col("s_es"))
    lag = F.floor(F.coalesce("lag_hr_cnt", F.lit(0.0)) * 60 + 0.5)
    p_kind = F.when(from_start, _kind(F.col("p_task_type"), "es")).otherwise(_kind(F.col("p_task_type"), "ef"))
    s_kind = F.when(to_finish, _kind(F.col("s_task_type"), "ef")).otherwise(_kind(F.col("s_task_type"), "es"))
    cand = both.withColumns({"gap": demand + lag - reference, "lag_min": lag, "same": p_kind == s_kind}).where("gap IS NOT NULL")
    cand = cand.where(~((F.col("lag_min") == 0) & (F.col("gap") < 0) & F.col("same")))
    best = Window.partitionBy("succ_id").orderBy(F.desc("gap"))
    return cand.withColumn("place", F.rank().over(best)).where("place = 1").select("succ_id", "pred_id", "pred_type", "gap").distinct()


def seeds(tasks: DataFrame, key: str) -> DataFrame:
    """Remaining tasks at their group's latest early finish, ties kept: ``(key, task_id)``."""
    live = tasks.where("status_code <> 'TK_Complete'").select(key, "task_id", minute_number(F.col("early_end_date")).alias("ef")).where("ef IS NOT NULL")
    last = live.groupBy(F.col(key).alias("k")).agg(F.max("ef").alias("m"))
    return live.join(last, (F.col(key) == F.col("k")) & (F.col("ef") == F.col("m"))).select(key, "task_id")


def _dfs(frame: pd.DataFrame) -> pd.DataFrame:
    """Backward walk of whole groups: members, and links that close a loop."""
    out = []
    for key, part in frame.groupby("key", sort=True, dropna=False):
        drivers: dict[int, list[int]] = {}
        starts = []
        for succ, pred in zip(part["succ_id"].tolist(), part["pred_id"].tolist(), strict=True):
            if pred != pred:  # a seed row has no predecessor
                starts.append(int(succ))
            else:
                drivers.setdefault(int(succ), []).append(int(pred))
        colour: dict[int, int] = {}
        back = dict.fromkeys(starts, 0)
        for start in sorted(set(starts)):
            if start in colour:
                continue
            colour[start] = 1
            stack = [(start, iter(sorted(drivers.get(start, ()))))]
            while stack:
                node, rest = stack[-1]
                nxt = next(rest, None)
                if nxt is None:
                    colour[node] = 2
                    stack.pop()
                elif nxt not in colour:
                    colour[nxt] = 1
                    stack.append((nxt, iter(sorted(drivers.get(nxt, ())))))
                elif colour[nxt] == 1:
                    back[node] = back.get(node, 0) + 1
        out += [(key, node, back.get(node, 0)) for node in colour]
    return pd.DataFrame(out, columns=["key", "task_id", "back_links"])


def fixpoint_members(starts: DataFrame, driving: DataFrame) -> DataFrame:
    """All tasks reached from ``starts(key, task_id)`` over their group's ``driving(key, succ_id, pred_id)``, in rounds of new nodes only."""
    seen = cut(starts.select("key", "task_id").distinct())
    front = seen
    while True:
        new = driving.join(front.withColumnRenamed("task_id", "succ_id"), ["key", "succ_id"]).select("key", F.col("pred_id").alias("task_id")).distinct()
        new = cut(new.join(seen, ["key", "task_id"], "left_anti"))
        if not new.limit(1).count():
            return seen
        seen, front = cut(seen.unionByName(new)), new


def loop_links(driving: DataFrame) -> DataFrame:
    """The links on loops and between them: tasks without remaining predecessors or successors are peeled off in rounds."""
    left = cut(driving)
    n = left.count()
    while n:
        preds, succs = left.select("key", F.col("pred_id").alias("succ_id")).distinct(), left.select("key", F.col("succ_id").alias("pred_id")).distinct()
        left = cut(left.join(succs, ["key", "pred_id"], "left_semi").join(preds, ["key", "succ_id"], "left_semi"))
        n, before = left.count(), n
        if n == before:
            break
    return left


def walk(tasks: DataFrame, links: DataFrame, key: str, local_limit: int = LOCAL_LIMIT) -> DataFrame:
    """``(key, task_id, back_links)``: members of each group's driving path.

    ``back_links`` counts the links out of a task that close a loop in a depth-first walk with
    seeds and predecessors in id order. In groups walked by fixpoint it counts a task's links
    among ``loop_links`` whose predecessor has no greater id: every loop has one, no other path
    has, but its task, and where loops meet the number, may differ from the depth-first walk.
    """
    own = tasks.select(F.col("task_id").alias("o_id"), F.col(key).alias("key"))
    driving = driving_links(tasks, links)
    edges = driving.join(own, F.col("succ_id") == F.col("o_id")).select("key", "succ_id", "pred_id")
    starts = seeds(tasks, key).select(F.col(key).alias("key"), F.col("task_id").alias("succ_id"), F.lit(None).cast("bigint").alias("pred_id"))
    rows = cut(edges.unionByName(starts).where("key IS NOT NULL"))
    big = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > local_limit).select(F.col("key").alias("big_key"))
    has_big = bool(big.limit(1).count())
    # A slot holds whole groups, about SLOT_ROWS rows of them, so its size does not follow the data's.
    slots = max(1, -(-rows.count() // SLOT_ROWS))
    few = rows.join(big, F.col("key") == F.col("big_key"), "left_anti") if has_big else rows
    small = few.groupBy(F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot")).applyInPandas(_dfs, "key string, task_id bigint, back_links bigint")
    small = small.select(F.col("key").alias(key), "task_id", "back_links")
    if not has_big:
        return small
    giant = cut(rows.join(big, F.col("key") == F.col("big_key"), "left_semi"))
    inner = giant.where("pred_id IS NOT NULL").select("key", "succ_id", "pred_id")
    found = fixpoint_members(giant.where("pred_id IS NULL").select("key", F.col("succ_id").alias("task_id")), inner)
    walked = inner.join(found.withColumnRenamed("task_id", "succ_id"), ["key", "succ_id"], "left_semi")
    back = loop_links(walked).where("pred_id <= succ_id").groupBy("key", F.col("succ_id").alias("task_id")).agg(F.count("*").alias("back_links"))
    wide = found.join(back, ["key", "task_id"], "left").select(F.col("key").alias(key), "task_id", F.coalesce("back_links", F.lit(0)).alias("back_links"))
    return small.unionByName(wide)


def path_details(tasks: DataFrame, links: DataFrame, members: DataFrame, data_minutes: DataFrame, key: str) -> DataFrame:
    """One row a group of tasks about its driving path: how it branches and ends, and whether it is whole.

    n_branches members have several drivers, n_tails none. A tail is grounded if it is active,
    starts by the data date of its group (``data_minutes(key, minutes)``) or has a complete
    predecessor. truncated: a member's link names a predecessor that is not there. A path is
    continuous without loops, truncation and ungrounded tails. Groups without members have
    zeros and no days.
    """
    drivers = driving_links(tasks, links).groupBy(F.col("succ_id").alias("d_id")).agg(F.count_distinct("pred_id").alias("n_drivers"))
    status = tasks.select(F.col("task_id").alias("p_id"), F.col("status_code").alias("p_status"))
    ends = links.where("succ_id IS NOT NULL AND pred_id IS NOT NULL").join(status, F.col("pred_id") == F.col("p_id"), "left")
    ends = ends.groupBy(F.col("succ_id").alias("e_id")).agg(F.bool_or(F.col("p_id").isNull()).alias("open_link"), F.coalesce(F.bool_or(F.col("p_status") == "TK_Complete"), F.lit(False)).alias("after_complete"))
    side = tasks.select(F.col("task_id").alias("t_id"), F.col(key).alias("t_key"), "status_code", minute_number(F.col("early_start_date")).alias("es"))
    data = data_minutes.select(F.col(key).alias("dd_key"), "minutes")
    m = members.select(key, "task_id", "back_links").join(side, F.col("task_id") == F.col("t_id")).join(data, F.col("t_key") == F.col("dd_key"), "left")
    m = m.join(drivers, F.col("task_id") == F.col("d_id"), "left").join(ends, F.col("task_id") == F.col("e_id"), "left")
    # A member of another group's task ends this group's path: its links belong to its own group.
    n = F.when(F.col("t_key") == F.col(key), F.coalesce("n_drivers", F.lit(0))).otherwise(0)
    grounded = (F.coalesce("status_code", F.lit("")) == "TK_Active") | F.coalesce(F.col("es") <= F.col("minutes"), F.lit(False)) | F.coalesce("after_complete", F.lit(False))
    walk = m.groupBy(F.col(key).alias("w_key")).agg(
        F.count("*").alias("n_members"), F.count_if(n > 1).alias("n_branches"), F.count_if(n == 0).alias("n_tails"), F.count_if((n == 0) & ~grounded).alias("n_ungrounded"),
        F.bool_or(F.coalesce("open_link", F.lit(False))).alias("truncated"), (F.sum("back_links") > 0).alias("has_loop"),
    )
    inside = members.select(F.col(key).alias("m_key"), F.col("task_id").alias("m_id"))
    flagged, member = F.upper(F.trim("driving_path_flag")) == "Y", F.col("m_id").isNotNull()
    own = tasks.where(F.col(key).isNotNull()).join(inside, (F.col("task_id") == F.col("m_id")) & (F.col(key) == F.col("m_key")), "left").groupBy(key).agg(
        F.count_if(flagged).alias("n_flagged"), F.count_if(flagged & member).alias("n_agreed"), F.count_if(flagged & (F.col("status_code") != "TK_Complete")).alias("n_flagged_remaining"),
        (F.datediff(F.max(F.when(member, real_day(F.col("early_end_date")))), F.min(F.when(member, real_day(F.col("early_start_date"))))) + 1).alias("calendar_days"),
    )
    out = own.join(walk, F.col(key) == F.col("w_key"), "left").drop("w_key").na.fill(0, ["n_members", "n_branches", "n_tails", "n_ungrounded"]).na.fill(False, ["truncated", "has_loop"])
    return out.withColumn("path_continuous", ~F.col("has_loop") & ~F.col("truncated") & (F.col("n_ungrounded") == 0) & (F.col("n_members") > 0))


def path_summary(tasks: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """One row a group of tasks: state, members, loops, span and share of the remaining work.

    state: skip without remaining tasks, unavailable without a readable early finish, error
    with a loop, else ok.
    """
    # A link across projects can make a task a member of two paths; it counts once, in its own project.
    inside = members.groupBy(F.col("task_id").alias("m_id")).agg(F.max("back_links").alias("back_links"))
    t = tasks.where(F.col(key).isNotNull()).join(inside, F.col("task_id") == F.col("m_id"), "left")
    live = F.col("status_code") != "TK_Complete"
    ef = minute_number(F.col("early_end_date"))
    flagged = F.upper(F.trim("driving_path_flag")) == "Y"
    member = F.col("m_id").isNotNull()
    g = t.groupBy(key).agg(
        F.count_if(live).alias("n_remaining"), F.count_if(live & ef.isNotNull()).alias("n_dated"), F.count_if(member).alias("n_members"),
        F.coalesce(F.sum("back_links"), F.lit(0)).alias("cycle_count"), F.count_if(flagged).alias("n_flagged"), F.count_if(flagged & member).alias("n_agreed"),
        F.min(F.when(member, F.col("early_start_date"))).alias("path_start"), F.max(F.when(member, F.col("early_end_date"))).alias("path_finish"),
    )
    state = F.when(F.col("n_remaining") == 0, "skip").when(F.col("n_dated") == 0, "unavailable").when(F.col("cycle_count") > 0, "error").otherwise("ok")
    share = F.when(F.col("n_remaining") > 0, F.floor(F.col("n_members") / F.col("n_remaining") * 1000 + 0.5) / 10)
    return g.withColumns({"state": state, "share_pct": share}).drop("n_dated")
