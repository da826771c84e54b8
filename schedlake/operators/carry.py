"""Ordered carry operators that survive one group holding most of the rows.

A plain window over ``PARTITION BY file`` sends a whole file to one task. Here the group is
cut into chunks of the order column; a chunk is windowed on its own, chunk summaries (one row
a chunk) are windowed across the group, and both are joined on (group, chunk), which the
chunk's window has partitioned already. Group keys must not be null; rows with a null order
number form their own chunk, which comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chunk of the rows without a number.
_NO_NUMBER = -(2**62)


def _chunked(df: DataFrame, number: str, chunk: int) -> DataFrame:
    return df.withColumn("__chunk", F.coalesce(F.floor(F.col(number) / chunk), F.lit(_NO_NUMBER)))


def carry_forward(
    df: DataFrame, keys: list[str], number: str, order: list[str], events: dict[str, Column], chunk: int = 4096
) -> DataFrame:
    """Add per event the last non-null value at or before each row of its group.

    ``number`` is the integer column that leads the order and cuts the chunks; ``order`` makes
    it total.
    """
    group = [*keys, "__chunk"]
    cut = _chunked(df, number, chunk).withColumns({f"__e_{k}": v for k, v in events.items()})
    near = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({k: F.last(f"__e_{k}", ignorenulls=True).over(near) for k in events})
    at = F.struct(*order)
    ends = cut.groupBy(*group).agg(*[F.max_by(f"__e_{k}", F.when(F.col(f"__e_{k}").isNotNull(), at)).alias(f"__p_{k}") for k in events])
    far = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*group, *[F.last(f"__p_{k}", ignorenulls=True).over(far).alias(f"__c_{k}") for k in events])
    return local.join(handed, group, "left").select(
        *[F.col(c) for c in df.columns], *[F.coalesce(F.col(k), F.col(f"__c_{k}")).alias(k) for k in events]
    )


def previous_row(
    df: DataFrame, keys: list[str], number: str, order: list[str], value: Column, name: str, chunk: int = 256
) -> DataFrame:
    """Add ``value`` of the row just before each row of its group, null for the first."""
    group = [*keys, "__chunk"]
    cut = _chunked(df, number, chunk).withColumn("__v", value)
    near = Window.partitionBy(*group).orderBy(*order)
    local = cut.withColumns({"__lag": F.lag("__v").over(near), "__rn": F.row_number().over(near)})
    ends = cut.groupBy(*group).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    far = Window.partitionBy(*keys).orderBy("__chunk")
    handed = ends.select(*group, F.lag("__last").over(far).alias("__before"))
    return local.join(handed, group, "left").select(
        *[F.col(c) for c in df.columns], F.when(F.col("__rn") == 1, F.col("__before")).otherwise(F.col("__lag")).alias(name)
    )
