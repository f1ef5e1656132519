"""Joins whose row side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import settle

HOT_SHARE = 1000
"""A key with more than one in HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE of them."""


def hot_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with facts (one row per key): hot keys by a broadcast of at most HOT_SHARE facts, others by shuffle.

    ``rows`` is scanned three times and should be a stored narrow table.  Null keys match nothing.
    """
    total = rows.count()
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot, n = settle(counts.where(F.col("_n") * HOT_SHARE > total).select(key))
    if not n:
        return rows.join(facts, key)
    hot = F.broadcast(hot)
    return (rows.join(F.broadcast(facts.join(hot, key)), key)
            .unionByName(rows.join(hot, key, "left_anti").join(facts, key)))
