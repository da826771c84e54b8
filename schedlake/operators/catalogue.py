"""Catalogue queries: shared predicates, facets, pages, rankings, counters.

Predicates are plain columns, so one definition serves the shelf, each facet (minus its own)
and every count.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.text import search_match, similarity, tokens, trigrams

#: Sector codes and size bands (closed ranges of activities) in order.
SECTORS = ("rail", "highways", "aviation", "marine", "building", "water", "power", "process")
SIZE_BANDS = {"s": (0, 499), "m": (500, 1999), "l": (2000, 5000), "xl": (5001, None)}
PAGE, LEADERBOARD, SUGGESTIONS = 25, 100, 5


@dataclass(frozen=True)
class ShelfQuery:
    """A shelf request; an empty facet does not filter."""

    sectors: tuple[str, ...] = ()
    sizes: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    progressed: bool = False
    owner: str | None = None
    text: str = ""
    sort: str = ""
    page: int = 1
    extra: dict = field(default_factory=dict)


def size_band(count: Column) -> Column:
    """Band code of an activity count; null for null or negative."""
    out = None
    for code, (low, high) in SIZE_BANDS.items():
        test = (count >= low) if high is None else count.between(low, high)
        out = F.when(test, code) if out is None else out.when(test, code)
    return out


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def facet_predicates(q: ShelfQuery) -> dict[str, Column]:
    """One predicate a facet over the joined shelf row."""
    on = F.lit(True)
    return {
        "sector": F.col("sector").isin(*q.sectors) if q.sectors else on,
        "size": _any([size_band(F.col("activity_count")) == s for s in q.sizes]) if q.sizes else on,
        "version": F.col("p6_version").isin(*q.versions) if q.versions else on,
        "progressed": F.col("pct_complete") > 0 if q.progressed else on,
    }


def published(programmes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Published programmes with their current published revision's facets."""
    p = programmes.where("status = 'published'").select(
        F.col("id").alias("programme_id"), "slug", "title", "description", "sector", "owner_user_id", "vote_count", "created_at", "parent_programme_id", "current_revision_id"
    )
    r = revisions.where("status = 'published'").select(
        F.col("id").alias("revision_id"), "rev_no", "p6_version", "activity_count", "pct_complete", "checks_passed", "checks_applicable", "uploaded_at"
    )
    return p.join(r, F.col("current_revision_id") == F.col("revision_id"))


def _filtered(shelf: DataFrame, q: ShelfQuery) -> DataFrame:
    out = reduce(DataFrame.where, facet_predicates(q).values(), shelf)
    if q.owner:
        out = out.where(F.col("owner_user_id") == q.owner)
    if q.text.strip():
        words = F.concat(tokens(F.col("title")), tokens(F.col("description")))
        out = out.where(search_match(words, q.text))
    return out


def relevance(query: str) -> Column:
    """Weighted share of query words in the title (1.0) and the description (0.4)."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    n = F.greatest(F.size(wanted), F.lit(1))
    hit = lambda c: F.size(F.array_intersect(wanted, tokens(F.col(c))))
    return (hit("title") * 1.0 + hit("description") * 0.4) / n


def sort_order(q: ShelfQuery) -> list[Column]:
    """The wanted order, made total by newest first and id."""
    chosen = q.sort or ("relevance" if q.text.strip() else "new")
    ratio = F.col("checks_passed") / F.nullif(F.col("checks_applicable").cast("double"), F.lit(0.0))
    first = {
        "new": [],
        "votes": [F.desc("vote_count")],
        "size": [F.desc_nulls_last("activity_count")],
        "quality": [ratio.desc_nulls_last(), F.desc_nulls_last("checks_applicable")],
        "relevance": [relevance(q.text).desc()],
    }[chosen]
    return [*first, F.desc("created_at"), F.desc("programme_id")]


def shelf_page(programmes: DataFrame, revisions: DataFrame, q: ShelfQuery) -> DataFrame:
    """One page of the shelf with the parent's title and the total, which is one counted row."""
    rows = _filtered(published(programmes, revisions), q)
    total = rows.agg(F.count("*").alias("total_count"))
    page = rows.orderBy(*sort_order(q)).offset((max(q.page, 1) - 1) * PAGE).limit(PAGE)
    parent = programmes.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    # The page has at most 25 rows and the total one: both are safe to broadcast.
    return parent.join(F.broadcast(page), F.col("parent_id") == F.col("parent_programme_id"), "right").drop("parent_id").join(F.broadcast(total))


def facet_counts(programmes: DataFrame, revisions: DataFrame, q: ShelfQuery) -> DataFrame:
    """``(facet, value, n)``: rows per facet value under all predicates but the facet's own.

    One scan: every row counts once a facet it passes. Sector, size and progressed values are
    zero-filled.
    """
    tests = facet_predicates(q)
    value = {
        "sector": F.col("sector"), "size": size_band(F.col("activity_count")), "version": F.col("p6_version"),
        "progressed": F.when(F.col("pct_complete") > 0, "yes"),
    }
    entries = []
    for name, v in value.items():
        others = reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for k, t in tests.items() if k != name])
        entries.append(F.when(others & v.isNotNull(), F.struct(F.lit(name).alias("facet"), v.alias("value"))))
    rows = published(programmes, revisions).select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    counts = rows.groupBy("facet", "value").agg(F.count("*").alias("n"))
    known = [("sector", s) for s in SECTORS] + [("size", s) for s in SIZE_BANDS] + [("progressed", "yes")]
    codes = programmes.sparkSession.createDataFrame(known, "facet string, value string")
    return counts.join(F.broadcast(codes), ["facet", "value"], "full").na.fill(0, ["n"])


def leaderboard(programmes: DataFrame, limit: int = LEADERBOARD) -> DataFrame:
    """Owners by votes, then listed programmes, then id, with their rank over the grouped rows."""
    listed = programmes.where("status = 'published' AND current_revision_id IS NOT NULL AND owner_user_id IS NOT NULL")
    grouped = listed.groupBy("owner_user_id").agg(F.sum("vote_count").alias("votes"), F.count("*").alias("n_programmes"))
    return grouped.orderBy(F.desc("votes"), F.desc("n_programmes"), "owner_user_id").limit(limit)


def rank_grouped(grouped: DataFrame, order: list[Column], bands: list[str] | None = None) -> DataFrame:
    """``rank()`` over grouped rows, in two steps so that no task sorts all of them.

    Rows are counted per distinct order key; ranks are running sums over the distinct keys.
    """
    ordered = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    names = bands or []
    keys = grouped.groupBy(*names).agg(F.count("*").alias("__n"))
    ranks = keys.withColumn("rank", F.coalesce(F.sum("__n").over(ordered), F.lit(0)) + 1).drop("__n")
    return grouped.join(ranks, names)


def suggestions(programmes: DataFrame, query: str, least: float = 0.3, limit: int = SUGGESTIONS) -> DataFrame:
    """Titles most like the query by trigrams, above ``least``: did you mean."""
    score = similarity(trigrams(F.col("title")), trigrams(F.lit(query)))
    rows = programmes.select("id", "title", score.alias("similarity")).where(F.col("similarity") > least)
    return rows.orderBy(F.desc("similarity"), "title", "id").limit(limit)


def filled_counts(owners: DataFrame, owner_key: str, facts: DataFrame, fact_key: str, name: str) -> DataFrame:
    """A denormalised counter rebuilt: facts per owner, zero where there are none."""
    n = facts.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("__k")).agg(F.count("*").alias(name))
    return owners.join(n, F.col(owner_key) == F.col("__k"), "left").drop("__k").na.fill(0, [name])


def latest_per_group(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of greatest order per group, as one aggregation without a sort."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*")


def duplicates(df: DataFrame, value: Column, key: str) -> DataFrame:
    """Rows sharing a value with another: ``(value, n, first_key)`` of values held more than once."""
    return df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")
