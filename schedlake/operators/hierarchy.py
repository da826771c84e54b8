"""Parent links to full hierarchies: roots, depths, paths, descendants, loops.

Components are found by pointer doubling over the parent links: every node jumps to the
ancestor twice as far each round, so a chain of length n takes log2(n) joins. Components of
up to ``local_limit`` nodes are then co-located and walked by an iterative depth-first
search with node colours, which yields pre-order spans, paths and back edges. A larger
component is never put into one task: the same columns come from doubling (sizes of subtrees
summed upward, places among siblings summed downward).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.operators.skew import HOT_LEAST, lookup
from schedlake.session import cut

#: Nodes of a component that one task may hold at once.
LOCAL_LIMIT = 200_000
#: Nodes a co-located bucket of small components aims at.
BUCKET_NODES = 50_000
#: Steps of paths handed on in one frame.
FRAME_STEPS = 1_000_000


def component_roots(nodes: DataFrame, rank: Column | None = None) -> DataFrame:
    """``(id, parent, root, depth, on_loop)`` for every node of ``nodes(id, parent)``.

    ``id`` is unique and not null; ``parent`` null, or the id of no node, makes a root. A node
    whose chain runs into a loop gets depth -1 and as root the loop's smallest id by ``rank``
    (an expression over ``id``; the id itself by default). Ids are compared exactly.
    """
    order = F.col("id") if rank is None else rank
    known = nodes.select(F.col("id").alias("p_id"))
    base = lookup(nodes.select("id", "parent", order.alias("rank")), "parent", known, "p_id")
    state = cut(
        base.select(
            "id",
            F.col("parent").alias("named"),
            F.coalesce("p_id", "id").alias("ptr"),
            F.when(F.col("p_id").isNotNull(), 1).otherwise(0).cast("bigint").alias("steps"),
            F.col("p_id").isNull().alias("done"),
            F.struct("rank", "id").alias("low"),
        )
    )
    finished = state.where("done")
    open_ = state.where("NOT done")
    left = open_.count()
    # A round that finishes nobody has passed the deepest tree node: what is left runs into loops.
    while left:
        ahead = state.select(
            F.col("id").alias("a_id"), F.col("ptr").alias("a_ptr"), F.col("steps").alias("a_steps"),
            F.col("done").alias("a_done"), F.col("low").alias("a_low"),
        )
        moved = lookup(open_, "ptr", ahead, "a_id", "inner", _hot(left)).select(
            "id", "named", F.col("a_ptr").alias("ptr"), (F.col("steps") + F.col("a_steps")).alias("steps"),
            F.col("a_done").alias("done"), F.least("low", "a_low").alias("low"),
        )
        moved = cut(moved)
        finished = finished.unionByName(moved.where("done"))
        open_ = moved.where("NOT done")
        state = finished.unionByName(open_)
        now = open_.count()
        if now == left:
            break
        left = now
    trees = finished.select("id", F.col("named").alias("parent"), F.col("ptr").alias("root"), F.col("steps").alias("depth"), F.lit(False).alias("on_loop"))
    if not left:
        return trees
    return trees.unionByName(_loops(open_, left))


def _hot(rows: int) -> list | None:
    """No key of so few rows is hot: spare the count (None lets ``lookup`` look for hot keys)."""
    return [] if rows <= HOT_LEAST else None


def _loops(open_: DataFrame, left: int) -> DataFrame:
    """Nodes that never reach a root. Jumps beyond their number land on loops, and on every loop node."""
    reach = 1
    steps = open_.agg(F.min("steps")).first()[0]
    while reach * steps < left:
        ahead = open_.select(F.col("id").alias("a_id"), F.col("ptr").alias("a_ptr"), F.col("low").alias("a_low"))
        open_ = cut(
            lookup(open_, "ptr", ahead, "a_id", "inner", _hot(left)).select(
                "id", "named", F.col("a_ptr").alias("ptr"), "steps", "done", F.least("low", "a_low").alias("low")
            )
        )
        reach *= 2
    on = open_.select(F.col("ptr").alias("l_id")).distinct()
    lows = open_.select(F.col("id").alias("a_id"), F.col("low").alias("a_low"))
    placed = lookup(open_, "ptr", lows, "a_id", "inner", _hot(left)).join(on, F.col("id") == F.col("l_id"), "left")
    return placed.select(
        "id", F.col("named").alias("parent"), F.col("a_low.id").alias("root"), F.lit(-1).cast("bigint").alias("depth"),
        F.col("l_id").isNotNull().alias("on_loop"),
    )


_WALK = "id string, parent string, root string, depth bigint, on_loop boolean, back_edge boolean, path array<string>, enter bigint, leave bigint"


def _walk(frame: pd.DataFrame, paths: bool) -> Iterator[pd.DataFrame]:
    """Depth-first search with colours over whole components, in one pass over the frame.

    Paths of a deep tree outgrow it by far, so they are built as they are handed on, a bounded number of steps at a time.
    """
    ids = frame["id"].tolist()
    parent = dict(zip(ids, frame["parent"].tolist(), strict=True))
    roots = dict(zip(ids, frame["root"].tolist(), strict=True))
    kids: dict[str, list[str]] = {}
    for i in sorted(ids):
        p = parent[i]
        if p is not None and p in parent:
            kids.setdefault(p, []).append(i)
    starts = sorted(i for i in ids if roots[i] == i)
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(ids, white)
    depth: dict[str, int] = {}
    enter: dict[str, int] = {}
    leave: dict[str, int] = {}
    back: set[str] = set()
    clock = 0
    last_root = None
    for start in starts:
        if roots[start] != last_root:
            clock, last_root = 0, roots[start]
        colour[start], depth[start], enter[start] = grey, 0, clock
        clock += 1
        stack = [(start, iter(kids.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                colour[node], leave[node] = black, clock
                stack.pop()
            elif colour[child] == white:
                colour[child], depth[child], enter[child] = grey, depth[node] + 1, clock
                clock += 1
                stack.append((child, iter(kids.get(child, ()))))
            elif colour[child] == grey:
                back.add(child)  # the link child -> node closes a loop
    # The loop through a back edge is the stack between its ends: the chain from the edge's foot.
    loop: set[str] = set()
    for foot in back:
        node = parent[foot]
        while node != foot:
            loop.add(node)
            node = parent[node]
        loop.add(foot)
    looping = {roots[f] for f in back}
    columns = [x.split()[0] for x in _WALK.split(", ")]
    out, steps = [], 0
    for i in ids:
        bad = roots[i] in looping
        path = None
        if paths and not bad:
            path = [i]
            while path[-1] != roots[i]:
                path.append(parent[path[-1]])
            path.reverse()
            steps += len(path)
        out.append((i, parent[i], roots[i], -1 if bad else depth[i], i in loop, i in back, path, enter[i], leave[i]))
        if steps > FRAME_STEPS:
            yield pd.DataFrame(out, columns=columns)
            out, steps = [], 0
    yield pd.DataFrame(out, columns=columns)


def _walk_buckets(frames: Iterator[pd.DataFrame], paths: bool) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by root: hold one run of whole components at a time."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        frame = frame.astype(object).where(frame.notna(), None)
        held.append(frame)
        size += len(frame)
        if size < BUCKET_NODES:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = whole["root"].iloc[-1]
        ready = whole[whole["root"] != last]
        if len(ready):
            yield from _walk(ready, paths)
        held = [whole[whole["root"] == last]]
        size = len(held[0])
    if size:
        yield from _walk(pd.concat(held, ignore_index=True), paths)


def _double_paths(giant: DataFrame) -> DataFrame:
    """Paths of tree nodes in giant components by doubling: append the path of the node jumped to."""
    state = cut(
        giant.select(
            "id", "parent", "root", "depth", F.array("id").alias("tail"),
            F.when(F.col("depth") > 0, F.col("parent")).alias("ptr"),
        )
    )
    while state.where("ptr IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("id").alias("a_id"), F.col("tail").alias("a_tail"), F.col("ptr").alias("a_ptr"))
        moved = lookup(state.where("ptr IS NOT NULL"), "ptr", ahead, "a_id", "inner").select(
            "id", "parent", "root", "depth", F.concat("a_tail", "tail").alias("tail"), F.col("a_ptr").alias("ptr")
        )
        state = cut(state.where("ptr IS NULL").unionByName(moved))
    return state.select("id", F.col("tail").alias("path"))


def _sums_below(nodes: DataFrame) -> DataFrame:
    """``(id, parent, value, below)`` of ``nodes(id, parent, value)``, a forest: the sum of value over each node's subtree, itself included.

    After k rounds a node holds the sum of all less than 2^k links below it, and hands it to
    the ancestor 2^k links above.
    """
    state = cut(nodes.select("id", "parent", "value", F.col("parent").alias("ptr"), F.col("value").alias("below")))
    while state.where("ptr IS NOT NULL").limit(1).count():
        given = state.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("g_id")).agg(F.sum("below").alias("more"))
        ahead = state.select(F.col("id").alias("a_id"), F.col("ptr").alias("a_ptr"))
        moved = lookup(state, "ptr", ahead, "a_id").join(given, F.col("id") == F.col("g_id"), "left")
        state = cut(moved.select("id", "parent", "value", F.col("a_ptr").alias("ptr"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
    return state.drop("ptr")


def _double_spans(giant: DataFrame) -> DataFrame:
    """``(id, enter, leave)`` of giant components, siblings in id order, each loop cut at its smallest node's link."""
    forest = giant.select("id", F.when(F.col("id") != F.col("root"), F.col("parent")).alias("parent"), F.lit(1).cast("bigint").alias("value"))
    sizes = _sums_below(forest).select("id", "parent", F.col("below").alias("size"))
    earlier = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("parent").isNull(), 0).otherwise(F.coalesce(F.sum("size").over(earlier), F.lit(0)) + 1)
    state = cut(sizes.where("parent IS NOT NULL").withColumn("enter", place).unionByName(sizes.where("parent IS NULL").withColumn("enter", F.lit(0).cast("bigint"))).withColumn("ptr", F.col("parent")))
    while state.where("ptr IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("id").alias("a_id"), F.col("ptr").alias("a_ptr"), F.col("enter").alias("a_enter"))
        moved = lookup(state, "ptr", ahead, "a_id")
        state = cut(moved.select("id", "parent", "size", (F.col("enter") + F.coalesce("a_enter", F.lit(0))).alias("enter"), F.col("a_ptr").alias("ptr")))
    return state.select(F.col("id").alias("s_id"), "enter", (F.col("enter") + F.col("size")).alias("leave"))


def subtree_sums(resolved: DataFrame, values: DataFrame) -> DataFrame:
    """``(id, own, total)`` of ``resolved(id, parent, depth)`` with ``values(v_id, v)``: each node's own value and that of its whole subtree.

    Nodes on or below a loop, which have no depth, count their own value alone. Parents that are not there end a chain.
    """
    own = resolved.join(values, F.col("id") == F.col("v_id"), "left").select("id", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), F.coalesce("v", F.lit(0)).cast("bigint").alias("value"))
    return _sums_below(own).select("id", F.col("value").alias("own"), F.col("below").alias("total"))


def resolve(nodes: DataFrame, rank: Column | None = None, local_limit: int = LOCAL_LIMIT, paths: bool = True) -> DataFrame:
    """Full hierarchy of ``nodes(id string, parent string)``, one row a node.

    Columns: id, parent, root, depth, on_loop, back_edge (its link closes a loop in the walk),
    path (root to node, null below or on a loop, and everywhere without ``paths``), enter and leave (pre-order span within the
    root's component: b is a descendant of a iff both share a root and
    a.enter <= b.enter < a.leave; a loop is entered at its smallest node), giant. Rows with a null id are
    left out; of repeated ids the caller keeps one. An empty table gives an empty result. A
    node naming itself as parent is a loop of one.
    """
    given = nodes.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent")).where("id IS NOT NULL")
    comps = cut(component_roots(given, rank))
    sizes = comps.groupBy("root").agg(F.count("*").alias("n"))
    giants = sizes.where(F.col("n") > local_limit).select(F.col("root").alias("g_root"))
    has_giant = bool(giants.limit(1).count())
    marked = comps.join(giants, F.col("root") == F.col("g_root"), "left") if has_giant else comps.withColumn("g_root", F.lit(None).cast("string"))
    small = marked.where("g_root IS NULL").select("id", "parent", "root")
    # A stated number of partitions is not coalesced: few bytes may be much work for Python.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = small.repartition(parts, "root").sortWithinPartitions("root").mapInPandas(lambda frames: _walk_buckets(frames, paths), _WALK).withColumn("giant", F.lit(False))
    if not has_giant:
        return walked
    big = marked.where("g_root IS NOT NULL")
    chains = _double_paths(big.where("depth >= 0")) if paths else big.select("id", F.lit(None).cast("array<string>").alias("path"))
    spans = _double_spans(big)
    wide = big.join(chains, "id", "left").join(spans, F.col("id") == F.col("s_id")).select(
        "id", "parent", "root", "depth", "on_loop", (F.col("on_loop") & (F.col("id") == F.col("root"))).alias("back_edge"), "path",
        "enter", "leave", F.lit(True).alias("giant"),
    )
    return walked.unionByName(wide)


def descendants(resolved: DataFrame) -> DataFrame:
    """``(id, descendant, distance)`` for every tree node and each node below it."""
    up = resolved.where("path IS NOT NULL").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "id"))
    return up.where("id <> descendant").select("id", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def latest_rows(df: DataFrame, key: str, stamp: str, *ties: str) -> DataFrame:
    """Of each key the row of latest ``stamp`` (nulls earliest; on equal stamps the greatest ``ties``, which settle which of differing rows counts).

    A window limited to one row a key on each side of its shuffle; only the columns that the
    caller goes on to use are read and shuffled. Rows without a key are left out.
    """
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(stamp), *[F.desc_nulls_last(t) for t in ties])
    return df.where(F.col(key).isNotNull()).withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def tree_facts(nodes: DataFrame, numeric: list[str]) -> DataFrame:
    """``(tree_name, node_id, root_id, depth, finding)`` of several trees at once, ``nodes(tree_name, id, parent, excused, stored_root)``.

    First finding that holds: cycle, below_cycle, dangling (own parent named, not in the table,
    not ``excused``), wrong_root (``stored_root``, a struct where the tree has stored roots,
    differs from the root found, null included), ok. Ids of the trees in ``numeric`` are
    ordered as numbers. One walk serves all trees: a node's key is its tree and id.
    """
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\t", "tree_name", F.col(c).cast("string")))
    given = nodes.where("id IS NOT NULL").select(key("id").alias("id"), key("parent").alias("parent"))
    tail = F.expr("substring(id, instr(id, '\t') + 1)")
    rank = F.when(F.substring_index("id", "\t", 1).isin(numeric), tail.try_cast("bigint"))
    done = resolve(given, rank, paths=False).select("id", "root", "depth", "on_loop")
    facts = nodes.select(
        "tree_name", key("id").alias("n_id"), F.col("id").cast("string").alias("node_id"), F.col("parent").isNotNull().alias("named"), F.coalesce("excused", F.lit(False)).alias("excused"), "stored_root"
    )
    root = F.expr("substring(root, instr(root, '\t') + 1)")
    finding = (
        F.when(F.col("on_loop"), "cycle")
        .when(F.col("depth") < 0, "below_cycle")
        .when((F.col("depth") == 0) & F.col("named") & ~F.col("excused"), "dangling")
        .when(F.col("stored_root").isNotNull() & ~F.col("stored_root.id").eqNullSafe(root), "wrong_root")
        .otherwise("ok")
    )
    return facts.join(done, F.col("n_id") == F.col("id")).select("tree_name", "node_id", root.alias("root_id"), F.col("depth").cast("int").alias("depth"), finding.alias("finding"))
