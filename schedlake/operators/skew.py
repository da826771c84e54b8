"""Lookups against a unique key that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of the rows, so at most ``1 / HOT_SHARE`` keys are hot.
HOT_SHARE = 0.005
#: Fewer rows than this never make a key hot.
HOT_LEAST = 100_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_LEAST) -> list:
    """Every key that holds more than ``share`` of the non-null rows, and perhaps a few others, of more than ``least`` rows.

    One pass with a frequent-items sketch, without a shuffle. It misses no hot key and holds at
    most ``1 / share`` keys whatever the data, which makes it safe to collect and to broadcast;
    a key too many costs a place in the broadcast, no row.
    """
    some = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    if some.count() <= least:
        return []
    return sorted(x for x in some.freqItems(["k"], share).first()[0] if x is not None)


def lookup(facts: DataFrame, key: str, table: DataFrame, table_key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join ``facts`` to ``table`` (unique in ``table_key``, other names distinct).

    Rows with a hot key meet a broadcast of those few table rows; all others meet in a
    shuffled join. Null keys find nothing; with ``how='left'`` they stay.
    """
    hot = hot_keys(facts, key) if hot is None else hot
    on: Column = F.col(key) == F.col(table_key)
    if not hot:
        return facts.join(table, on, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = table.where(F.col(table_key).isin(hot))
    return facts.where(is_hot).join(F.broadcast(few), on, how).unionByName(facts.where(~is_hot).join(table, on, how))
