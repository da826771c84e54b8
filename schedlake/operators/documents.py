"""Result documents: activities, facets and the derived document, with a size budget, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document versions and the derived document's byte limits.
DERIVED_VERSION, ACTIVITIES_VERSION = 4, 2
WARN_BYTES, MAX_BYTES = 100_000, 150_000
_COLUMNS = (
    "task_id", "task_code", "task_name", "wbs_id", "task_type", "status_code", "target_drtn_hr_cnt", "remain_drtn_hr_cnt", "total_float_hr_cnt",
    "early_start_date", "early_end_date", "act_start_date", "act_end_date",
)


def activities(tasks: DataFrame, members: DataFrame) -> DataFrame:
    """The activity table: its columns and whether each task is on the driving path.

    Kept as rows, since parquet is columnar by itself and a row per task has no group bound.
    """
    inside = members.select(F.col("task_id").alias("m_id")).distinct()
    return tasks.join(inside, F.col("task_id") == F.col("m_id"), "left").select("proj_id", *_COLUMNS, F.col("m_id").isNotNull().alias("driving"))


def within_budget(document: Column, lists: Column, issues: Column) -> Column:
    """JSON of a document: whole up to the limit; above it without its lists, and with an issue saying so."""
    whole = F.to_json(F.struct(document.alias("stats"), lists.alias("lists"), issues.alias("issues")))
    note = F.array(F.struct(F.lit("document").alias("stat"), F.lit("warn").alias("severity"), F.lit("lists dropped: the document exceeds its size budget").alias("reason")))
    small = F.to_json(F.struct(document.alias("stats"), F.concat(issues, note).alias("issues")))
    return F.when(F.octet_length(whole) > MAX_BYTES, small).otherwise(whole)


def derived(groups: dict[str, DataFrame], lists: dict[str, DataFrame], key: str = "proj_id") -> DataFrame:
    """One derived document a key: ``(key, derived_version, document, over_warn)``.

    Each group is one row a key. ``lists`` holds what a document loses first when it exceeds
    its budget: frames with rows of their own (at most 50 exemplars a check), or with one array
    column a key. A group a key lacks comes out null and is named in the issues.
    """
    joined = None
    for name, part in groups.items():
        one = part.where(F.col(key).isNotNull()).select(key, F.struct(*[c for c in part.columns if c != key]).alias(name))
        joined = one if joined is None else joined.join(one, key, "full")
    for name, part in lists.items():
        cols = [c for c in part.columns if c != key]
        if len(cols) > 1:
            first = [c for c in ("check_no", "place") if c in cols]
            part = part.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*first, *[c for c in cols if c not in first]))).alias(name))
        joined = joined.join(part.select(key, F.col(part.columns[-1]).alias(name)), key, "left")
    gone = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.struct(F.lit(n).alias("stat"), F.lit("error").alias("severity"), F.lit("not available").alias("reason"))) for n in groups]))
    text = within_budget(F.struct(*groups), F.struct(*lists), gone)
    return joined.select(key, F.lit(DERIVED_VERSION).alias("derived_version"), text.alias("document"), (F.octet_length(text) > WARN_BYTES).alias("over_warn"))


def write_documents(docs: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Write gzip JSON documents; the same keys overwrite, so a retry leaves one result."""
    out = docs.write.mode("overwrite").option("compression", "gzip")
    (out.partitionBy(*partition) if partition else out).json(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``: a key in both takes the new row. Files are never edited in place."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it lacks, one a key."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh)
