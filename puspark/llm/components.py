"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puspark.sources.shared import materialise

#: Edges of a task, in the mean; each core has a task all the same.
TASK_EDGES = 1 << 16


def _packed(rows: DataFrame, edges: int) -> DataFrame:
    """``rows`` in as many partitions as so many edges need, however many a shuffle makes: rounds are many, and tasks
    and files of a few rows take longer than the rows do. No partition is moved for it."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, edges // TASK_EDGES))


def _nearest(edges: DataFrame, n: int) -> DataFrame:
    """Every edge u -> v with ``m``, the least neighbour of u. Minima combine before the shuffle and are written, so that
    both sides of the join are shuffled for it: adaptive execution can split a node with very many neighbours then."""
    minima = materialise(_packed(edges.groupBy("u").agg(F.min("v").alias("m")), n))
    return _packed(edges.join(minima, "u"), n)


def _step(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least("u", "m")
    large = _nearest(both, n).filter("v > u").select(F.col("v").alias("u"), least.alias("v")).filter("u > v").distinct()
    large = materialise(_packed(large, n))
    ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    small = _nearest(large, n).select(F.inline(ends))
    return _packed(small.filter("u > v").distinct(), n)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on a link; the component is its least node. Nulls and loops link nothing.

    The number of rounds grows with the logarithm of the longest path. Each round's edges are written to the shared
    folder, so that a lost executor repeats one round at most; only a checksum comes to the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    seen = None
    while True:
        edges = materialise(edges)
        check = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if check == seen or check[0] == 0:
            break
        seen, edges = check, _step(edges, check[0])
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
