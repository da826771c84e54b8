"""Critical-path method on a project's network: early and late times, total and free float.

One project is one file, and the ingest verdict refuses files above the activity cap, so a
project's network mostly fits one task. A larger group is relaxed in distributed rounds, one
for each topological level.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.session import cut

#: Fixed value: activities that one export may hold.
ACTIVITY_CAP = 20_000


def _order(ids: list[int], succs: dict[int, list[tuple[int, str, float]]]) -> list[int]:
    """Topological order; tasks on or behind a loop are left out."""
    need = dict.fromkeys(ids, 0)
    for out in succs.values():
        for s, _, _ in out:
            need[s] += 1
    ready = sorted((i for i in ids if need[i] == 0), reverse=True)
    order = []
    while ready:
        node = ready.pop()
        order.append(node)
        for s, _, _ in succs.get(node, ()):
            need[s] -= 1
            if need[s] == 0:
                ready.append(s)
    return order


def network_times(tasks: list[tuple[int, float]], links: list[tuple[int, int, str, float]]) -> dict[int, tuple[float, float, float, float, float, float]]:
    """Early start and finish, late start and finish, total float, free float of each task, in hours."""
    length = dict(tasks)
    succs: dict[int, list[tuple[int, str, float]]] = {}
    for pred, succ, kind, lag in links:
        if pred in length and succ in length and pred != succ:
            succs.setdefault(pred, []).append((succ, kind, lag))
    order = _order(sorted(length), succs)
    early = dict.fromkeys(order, 0.0)
    for p in order:
        for s, kind, lag in succs.get(p, ()):
            if s in early:
                base = early[p] + (0.0 if kind in ("PR_SS", "PR_SF") else length[p]) + lag
                early[s] = max(early[s], base - (length[s] if kind in ("PR_FF", "PR_SF") else 0.0))
    end = max((early[i] + length[i] for i in order), default=0.0)
    late = {i: end - length[i] for i in order}
    free: dict[int, float] = {}
    for p in reversed(order):
        for s, kind, lag in succs.get(p, ()):
            if s not in late:
                continue
            gap = (length[s] if kind in ("PR_FF", "PR_SF") else 0.0) - lag - (0.0 if kind in ("PR_SS", "PR_SF") else length[p])
            late[p] = min(late[p], late[s] + gap)
            free[p] = min(free.get(p, float("inf")), early[s] + gap - early[p])
    return {
        i: (early[i], early[i] + length[i], late[i], late[i] + length[i], late[i] - early[i], max(0.0, free.get(i, late[i] - early[i]))) for i in order
    }


def _relax(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(key, task_id, x)`` with x the greatest of its own and x + w over ``edges(key, src, dst, w)`` into it.

    One round a topological level; nodes on or behind a loop are left out.
    """
    need = edges.groupBy("key", F.col("dst").alias("task_id")).agg(F.count("*").alias("need"))
    state = cut(nodes.join(need, ["key", "task_id"], "left").select("key", "task_id", "x", F.coalesce("need", F.lit(0)).alias("need")))
    while True:
        # need is 0 for a node whose turn it is, -1 after it.
        front = state.where("need = 0").select("key", F.col("task_id").alias("src"), F.col("x").alias("from_x"))
        if not front.limit(1).count():
            return state.where("need < 0").drop("need")
        push = edges.join(front, ["key", "src"]).groupBy("key", F.col("dst").alias("task_id")).agg(F.count("*").alias("n"), F.max(F.col("from_x") + F.col("w")).alias("new_x"))
        left = F.when(F.col("need") <= 0, -1).otherwise(F.col("need") - F.coalesce("n", F.lit(0)))
        state = cut(state.join(push, ["key", "task_id"], "left").select("key", "task_id", F.greatest("x", "new_x").alias("x"), left.alias("need")))


def giant_times(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """``network_times`` of groups of any size, of ``tasks(key, task_id, hours)`` and ``links(key, pred_id, succ_id, pred_type, lag)``."""
    tasks = cut(tasks.dropDuplicates(["key", "task_id"]))
    side = lambda name: tasks.select("key", F.col("task_id").alias(f"{name}_id"), F.col("hours").alias(f"{name}_hours"))
    both = links.where("pred_id <> succ_id").join(side("pred"), ["key", "pred_id"]).join(side("succ"), ["key", "succ_id"])
    from_start, to_finish = F.col("pred_type").isin("PR_SS", "PR_SF"), F.col("pred_type").isin("PR_FF", "PR_SF")
    w = F.when(from_start, 0.0).otherwise(F.col("pred_hours")) + F.col("lag") - F.when(to_finish, F.col("succ_hours")).otherwise(0.0)
    edges = cut(both.select("key", F.col("pred_id").alias("src"), F.col("succ_id").alias("dst"), w.alias("w")))
    early = cut(_relax(tasks.select("key", "task_id", F.lit(0.0).alias("x")), edges).withColumnRenamed("x", "early").join(tasks, ["key", "task_id"]))
    ends = early.groupBy("key").agg(F.max(F.col("early") + F.col("hours")).alias("end"))
    at = lambda name: early.select("key", F.col("task_id").alias(name), F.col("early").alias(f"{name}_early"))
    inner = cut(edges.join(at("src"), ["key", "src"]).join(at("dst"), ["key", "dst"]))
    # Backwards the same rounds run on negated late starts.
    last = early.join(ends, "key").select("key", "task_id", (F.col("hours") - F.col("end")).alias("x"))
    late = _relax(last, inner.select("key", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).withColumn("late", F.lit(0.0) - F.col("x")).drop("x")
    free = inner.groupBy("key", F.col("src").alias("task_id")).agg(F.min(F.col("dst_early") - F.col("w") - F.col("src_early")).alias("free"))
    e, l, h = F.col("early"), F.col("late"), F.col("hours")
    return early.join(late, ["key", "task_id"]).join(free, ["key", "task_id"], "left").select(
        "key", "task_id", e.alias("early_start"), (e + h).alias("early_finish"), l.alias("late_start"), (l + h).alias("late_finish"),
        (l - e).alias("total_float"), F.greatest(F.lit(0.0), F.coalesce("free", l - e)).alias("free_float"),
    )


_OUT = "key string, task_id bigint, early_start double, early_finish double, late_start double, late_finish double, total_float double, free_float double"


def schedule(tasks: DataFrame, links: DataFrame, cap: int = ACTIVITY_CAP) -> DataFrame:
    """CPM of every group of ``tasks(key, task_id, hours)`` with ``links(key, pred_id, succ_id, pred_type, lag_hr_cnt)``.

    Null durations and lags are 0; unknown link types are finish-to-start; links to other groups
    do not count; tasks on or behind a loop have no row. Groups above ``cap`` tasks are never
    put into one task, see ``giant_times``.
    """
    sizes = cut(tasks.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")))

    def part(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (
            tasks.join(keys, "key").select("key", "task_id", F.coalesce("hours", F.lit(0.0)).alias("hours")),
            links.join(keys, "key").select("key", "pred_id", "succ_id", "pred_type", F.coalesce("lag_hr_cnt", F.lit(0.0)).alias("lag")),
        )

    left, right = part(sizes.where(F.col("n") <= cap).select("key"))

    def run(key: tuple, t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        times = network_times(
            list(zip(t["task_id"].tolist(), t["hours"].tolist(), strict=True)),
            list(zip(e["pred_id"].tolist(), e["succ_id"].tolist(), e["pred_type"].tolist(), e["lag"].tolist(), strict=True)),
        )
        return pd.DataFrame([(key[0], i, *x) for i, x in times.items()], columns=[c.split()[0] for c in _OUT.split(", ")])

    small = left.groupBy("key").cogroup(right.groupBy("key")).applyInPandas(run, _OUT)
    big = sizes.where(F.col("n") > cap).select("key")
    return small.unionByName(giant_times(*part(big))) if big.limit(1).count() else small


def critical_chains(times: dict[int, tuple], links: list[tuple[int, int, str, float]], limit: int = 10) -> list[list[int]]:
    """Float paths: chains of least total float, then latest finish, then id; each task once."""
    preds: dict[int, list[int]] = {}
    for p, s, _, _ in links:
        if p in times and s in times:
            preds.setdefault(s, []).append(p)
    left, out = set(times), []
    while left and len(out) < limit:
        node = min(left, key=lambda i: (times[i][4], -times[i][1], i))
        chain = []
        while node is not None:
            chain.append(node)
            left.discard(node)
            node = min((p for p in preds.get(node, ()) if p in left), key=lambda i: (times[i][4], -times[i][1], i), default=None)
        out.append(chain[::-1])
    return out
