"""Running sums and maxima over a global order, without gathering the order in one task.

Rows are placed in blocks that follow the order (quantile buckets of a column, ranges of positions,
prefixes of a hash). The block totals, one row per block, are accumulated first; a window then runs inside
each block, starting from what came before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 15
#: Rows per block that the edges between blocks are taken from.
EDGE_ROWS = 64


class Scan(NamedTuple):
    """One running aggregate: ``how`` is ``sum``, ``xor`` (of integers) or ``max``; ``upto`` 0 includes the row itself, -1
    stops before it. Sums and xors of nothing are 0."""

    name: str
    value: Column
    how: str
    upto: int = 0


_HOW = {"sum": F.sum, "xor": F.bit_xor, "max": F.max}


def double_array(values: Sequence[float]) -> Column:
    """A literal array; as one expression text, for a literal per value takes long to put together."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def block_size(n: int, block_rows: int = BLOCK_ROWS) -> int:
    """Rows per block: at least ``block_rows``, and the root of ``n`` beyond, so that neither blocks nor totals gather."""
    return max(block_rows, math.isqrt(n))


def bucket_edges(df: DataFrame, column: str, n: int | None = None, block_rows: int = BLOCK_ROWS) -> list[float]:
    """Strictly increasing quantile edges of ``column``, about one block apart; ``n``: rows of ``df``, or a bound of them.

    The edges only balance the work: any edges give the same results. So they are taken from a fixed number of rows
    per block, chosen by a hash of the value, and no task merges summaries of the whole table.
    """
    n = df.count() if n is None else n
    parts = math.ceil(n / block_size(n, block_rows))
    if parts < 2:
        return []
    every = max(1, n // (parts * EDGE_ROWS))
    chosen = df.filter(F.pmod(F.xxhash64(column), F.lit(every)) == 0)
    shares = double_array([i / parts for i in range(1, parts)])
    quantiles = chosen.agg(F.percentile_approx(column, shares, max(10_000, 4 * parts)).alias("q")).first()["q"]
    return sorted(set(quantiles or []))


def with_bucket(df: DataFrame, column: str, edges: Sequence[float], name: str = "bucket") -> DataFrame:
    """Add the number of edges at or below ``column``: 0 everywhere if there are none."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *edges, math.inf]
    placed = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)
    return placed.withColumn(name, F.col(name).cast("int"))


def two_level_scan(
    df: DataFrame, scans: Sequence[Scan], order: Sequence[str], block: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Add running aggregates along ``order`` within ``keys``; ``block`` must not decrease along the order."""
    groups = [*keys, block]
    values = [f"_v_{s.name}" for s in scans]
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*groups).agg(*[_HOW[s.how](s.value).alias(v) for s, v in zip(scans, values)])
    # what came before a block enters it as one more row at its head: no join, and the rows are shuffled once
    heads = totals.select(
        *groups, F.lit(0).alias("_row"), *[_HOW[s.how](v).over(earlier).alias(v) for s, v in zip(scans, values)]
    )
    rows = df.select("*", F.lit(1).alias("_row"), *[s.value.alias(v) for s, v in zip(scans, values)])
    inside = [Scan(s.name, F.col(v), s.how, s.upto) for s, v in zip(scans, values)]
    both = rows.unionByName(heads, allowMissingColumns=True)
    return _one_level_scan(both, inside, ["_row", *order], groups).filter("_row = 1").drop("_row", *values)


def _one_level_scan(df: DataFrame, scans: Sequence[Scan], order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(*order)
    running = {}
    for s in scans:
        frame = along.rowsBetween(Window.unboundedPreceding, s.upto)
        value = _HOW[s.how](s.value).over(frame)
        running[s.name] = value if s.how == "max" else F.coalesce(value, F.lit(0))
    return df.withColumns(running)
