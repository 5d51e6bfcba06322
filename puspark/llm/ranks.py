"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from puspark.sources.shared import materialise


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with its 1-based position in ``order``: ranges are ranked by themselves and shifted by the rows before.

    Rows that ``order`` leaves tied get their positions in any order. One task ranks the ranges' totals, which are as
    many as there are partitions.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(shift, "_part").withColumn(name, within + F.col("_before")).drop("_part", "_n", "_before")
