"""References to records that do not exist: direct orphans, and a fixpoint cascade below them.

Direct orphans come from each reference on its own (missing, deleted, late). Then children of
orphaned records are orphaned too, indirectly: semi-joins run down the foreign-key graph, table
by table in the order of their dependence, and again as long as a table above gains orphans.
Links within one table are a tree of unknown depth; the nearest orphan above each record is
found by pointer doubling, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions.numbers import blank_trim
from schedlake.operators.skew import lookup
from schedlake.session import cut, store


@dataclass(frozen=True)
class Table:
    """A loaded table: rows repeat per load of a record."""

    name: str
    rows: DataFrame
    key: str
    loaded_at: str = "loaded_at"
    deleted_at: str | None = "deleted_at"
    #: Whether a record whose own latest row is deleted refers to nothing.
    deleted_refers: bool = True


@dataclass(frozen=True)
class Reference:
    """A foreign key of ``child`` named ``field`` into ``parent``."""

    child: str
    field: str
    parent: str


def key_text(value: Column) -> Column:
    """A key as text without blanks around it; blank is null."""
    return F.nullif(blank_trim(value.cast("string")), F.lit(""))


def record_states(table: Table, fields: list[str]) -> DataFrame:
    """One row a record: key, first load, the latest row's deletion mark and reference texts.

    The latest row is the one of latest load; on equal loads a deleted row counts as later.
    Rows without a key are no records.
    """
    gone = F.col(table.deleted_at) if table.deleted_at and table.deleted_at in table.rows.columns else F.lit(None).cast("timestamp_ntz")
    stamp = F.col(table.loaded_at)
    row = F.struct(
        stamp.alias("at"), gone.isNotNull().alias("gone"),
        F.struct(*[key_text(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)], F.lit(0).alias("pad")).alias("refs"),
    )
    return (
        table.rows.groupBy(key_text(F.col(table.key)).alias("key"))
        .agg(F.min(stamp).alias("first_at"), F.max(row).alias("last"))
        .where("key IS NOT NULL")
        .select("key", "first_at", F.col("last.gone").alias("gone"), *[F.col(f"last.refs.f{i}").alias(f) for i, f in enumerate(fields)])
    )


def _states(tables: dict[str, Table], references: list[Reference]) -> dict[str, DataFrame]:
    """``record_states`` of each table in the references, with all its reference fields; stored where it is read more than once."""
    out = {}
    for name in dict.fromkeys(n for r in references for n in (r.child, r.parent)):
        fields = list(dict.fromkeys(r.field for r in references if r.child == name))
        state = record_states(tables[name], fields)
        roles = bool(fields) + len({r.child for r in references if r.parent == name})
        out[name] = store(state) if roles > 1 else state
    return out


def _referring(tables: dict[str, Table], states: dict[str, DataFrame], name: str) -> DataFrame:
    return states[name] if tables[name].deleted_refers else states[name].where("NOT gone")


def direct_orphans(tables: dict[str, Table], references: list[Reference], states: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(table_name, field_name, record_key, reason, period)`` of references that fail themselves.

    First reason that holds: missing (no row has the key), deleted (the target's latest row is
    deleted), late (the target was first loaded after the referring record). A null or blank
    key refers to nothing. ``period`` is the month of the referring record's first load.
    """
    states = _states(tables, references) if states is None else states
    parts = []
    for child, parent in dict.fromkeys((r.child, r.parent) for r in references):
        fields = [r.field for r in references if (r.child, r.parent) == (child, parent)]
        refs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("fk")) for f in fields])).alias("ref")
        used = _referring(tables, states, child).select(F.col("key").alias("record_key"), "first_at", refs).select("record_key", "first_at", "ref.*").where("fk IS NOT NULL")
        targets = states[parent].select(F.col("key").alias("t_key"), F.col("first_at").alias("t_first"), F.col("gone").alias("t_gone"))
        joined = lookup(used, "fk", targets, "t_key")
        reason = (
            F.when(F.col("t_key").isNull(), "missing")
            .when(F.col("t_gone"), "deleted")
            .when(F.col("t_first") > F.col("first_at"), "late")
        )
        parts.append(
            joined.select(
                F.lit(child).alias("table_name"), F.col("field").alias("field_name"), "record_key",
                reason.alias("reason"), F.date_format("first_at", "yyyy-MM").alias("period"),
            ).where("reason IS NOT NULL")
        )
    return reduce(DataFrame.unionByName, parts)


def _top_down(references: list[Reference]) -> list[str]:
    """The tables, parents before children as far as the graph has no loops between tables."""
    names = list(dict.fromkeys(n for r in references for n in (r.parent, r.child)))
    out: list[str] = []
    while rest := [n for n in names if n not in out]:
        free = [n for n in rest if all(r.parent in out or r.parent == n for r in references if r.child == n)]
        out += free or rest[:1]
    return out


def _below_within(links: DataFrame, bad: DataFrame) -> DataFrame:
    """``bad(record_key, level, field_name)`` and all that hangs below it over ``links(record_key, fk)`` of one table.

    A record's level is the least over its ancestors, one more for each link. After k rounds a
    record knows its ancestors up to 2^k links away, and where to look on.
    """
    own = bad.select(F.col("record_key").alias("b_key"), F.col("level").cast("bigint").alias("own"), F.col("field_name").alias("own_field"))
    start = links.select(F.col("record_key").alias("id"), F.col("fk").alias("ptr"), "field_name").join(own, F.col("id") == F.col("b_key"), "full")
    none = F.lit(None).cast("bigint")
    state = cut(start.select(F.coalesce("id", "b_key").alias("id"), "ptr", F.lit(1).cast("bigint").alias("step"), "field_name", "own", "own_field", none.alias("via")))
    n, reach = state.count(), 1
    while reach <= n and state.where("ptr IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("id").alias("a_id"), F.col("ptr").alias("a_ptr"), F.least("own", "via").alias("a_best"))
        moved = lookup(state, "ptr", ahead, "a_id").withColumn("via", F.least("via", F.col("a_best") + F.col("step")))
        state = cut(moved.select("id", F.col("a_ptr").alias("ptr"), (F.col("step") * 2).alias("step"), "field_name", "own", "own_field", "via"))
        reach *= 2
    best = F.least("own", "via")
    fields = F.least(F.when(F.col("own") == best, F.col("own_field")), F.when(F.col("via") == best, F.col("field_name")))
    return state.where(best.isNotNull()).select(F.col("id").alias("record_key"), best.cast("int").alias("level"), fields.alias("field_name"))


class Cascade:
    """Direct orphans of ``references``, and what hangs below them down the foreign-key graph ``below``.

    ``direct`` has the columns of ``direct_orphans``; nothing else is worked out before ``run``.
    """

    def __init__(self, tables: dict[str, Table], references: list[Reference], below: list[Reference] | None = None) -> None:
        self.tables, self.graph = tables, references if below is None else below
        self.states = _states(tables, list(dict.fromkeys([*references, *(below or [])])))
        self.direct = direct_orphans(tables, references, self.states)

    def _inherited(self, name: str, reached: dict[str, DataFrame]) -> DataFrame | None:
        """Level and field of the records of a table that hang directly below orphans of other tables."""
        hits = []
        for r in (r for r in self.graph if r.child == name != r.parent and r.parent in reached):
            bad = reached[r.parent].select(F.col("record_key").alias("t_key"), "level")
            links = _referring(self.tables, self.states, name).where(F.col(r.field).isNotNull()).select(F.col("key").alias("record_key"), F.col(r.field).alias("fk"))
            hits.append(lookup(links, "fk", bad, "t_key", "inner").select("record_key", (F.col("level") + 1).alias("level"), F.lit(r.field).alias("field_name")))
        return reduce(DataFrame.unionByName, hits) if hits else None

    def run(self) -> DataFrame:
        """Direct orphans at level 0 and inherited ones at levels 1, 2, ...

        Columns: table_name, field_name, record_key, reason (null above level 0), period, level.
        A direct orphan has a row for each reference that fails; any other record one, at the
        least number of links to a direct orphan, with the first such field by name.
        """
        direct = store(self.direct)
        reached: dict[str, DataFrame] = {}
        sizes: dict[str, tuple] = {}
        order = _top_down(self.graph)
        stale = set(order)
        while stale:
            name = next(n for n in order if n in stale)
            stale.discard(name)
            own = direct.where(F.col("table_name") == name).select("record_key", F.lit(0).alias("level"), "field_name")
            inherited = self._inherited(name, reached)
            every = own if inherited is None else own.unionByName(inherited)
            first = every.groupBy("record_key").agg(F.min(F.struct("level", "field_name")).alias("x")).select("record_key", "x.*")
            for r in (r for r in self.graph if r.child == r.parent == name):
                links = _referring(self.tables, self.states, name).where(F.col(r.field).isNotNull())
                first = _below_within(links.select(F.col("key").alias("record_key"), F.col(r.field).alias("fk"), F.lit(r.field).alias("field_name")), first)
            reached[name] = store(first)
            size = tuple(reached[name].agg(F.count("*"), F.sum("level")).first())
            # Levels only fall and records are only added, so equal sums mean that nothing has changed.
            if size != sizes.get(name, (0, None)):
                stale |= {r.child for r in self.graph if r.parent == name != r.child}
            sizes[name] = size
        out = direct.withColumn("level", F.lit(0))
        for name, found in reached.items():
            month = self.states[name].select(F.col("key").alias("m_key"), F.date_format("first_at", "yyyy-MM").alias("period"))
            more = found.where("level > 0").join(month, F.col("record_key") == F.col("m_key"), "left")
            out = out.unionByName(more.select(F.lit(name).alias("table_name"), "field_name", "record_key", F.lit(None).cast("string").alias("reason"), "period", "level"))
        return out


def orphan_cascade(tables: dict[str, Table], references: list[Reference], below: list[Reference] | None = None) -> DataFrame:
    """``Cascade(...).run()``; ``below`` is ``references`` by default and may hold self references."""
    return Cascade(tables, references, below).run()
