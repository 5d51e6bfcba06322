"""Joins that stay balanced when a key is hot, and broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; beyond that Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skewed_join(rows: DataFrame, table: DataFrame, key: str, count: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with a written ``table`` of one (or few) rows per key, which knows each key's ``count``.

    A key with a large share of all rows would send that share to one task. Such keys - by their number of rows
    there is at most one per ``hot_rows`` rows - are joined by broadcast, all others by shuffle.
    """
    hot = table.filter(F.col(count) > hot_rows)
    if hot.isEmpty():
        return rows.join(table, key)
    names = small_side(hot.select(key).distinct())
    rest = rows.join(names, key, "left_anti").join(table.filter(F.col(count) <= hot_rows), key)
    return rest.unionByName(rows.join(small_side(hot), key))
