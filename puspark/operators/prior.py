"""The D curve of the density ratio and the class prior read off its sharpest bend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns


def prior_curve(ratio: DataFrame, steps: int = 1000) -> DataFrame:
    """(i, alpha, d, d2, is_star): D(alpha) = alpha - mean(min(alpha * r, 1)) on ``steps`` points of [0, 1].

    Each ratio only matters through the first grid point at which alpha * r reaches 1, so ratios are summed
    per such point (at most steps + 1 rows) and the curve is accumulated over those sums.
    """
    require_columns(ratio, ["r", "n_rows"])
    if steps < 3:
        raise ValueError("the second difference needs at least 3 steps")
    spark = ratio.sparkSession
    # how many grid points lie below 1 / r; all of them for r < 1
    reached = F.when(F.col("r") < 1, F.lit(steps)).otherwise(F.ceil((steps - 1) / F.col("r")))
    hist = (
        ratio.filter(F.col("r").isNotNull())
        .groupBy(reached.cast("long").alias("i"))
        .agg(F.sum(F.col("r") * F.col("n_rows")).alias("_r"), F.sum("n_rows").alias("_n"))
    )
    grid = spark.range(steps + 1).withColumnRenamed("id", "i").join(hist, "i", "left")
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alpha = F.col("i") / F.lit(steps - 1)
    capped = F.coalesce(F.sum("_n").over(upto), F.lit(0))
    linear = F.coalesce(F.sum("_r").over(after), F.lit(0.0))
    curve = grid.select(
        F.col("i").cast("int").alias("i"),
        alpha.alias("alpha"),
        (alpha - (alpha * linear + capped) / F.sum("_n").over(everything)).alias("d"),
    ).filter(F.col("i") < steps)
    return mark_star(curve)


def mark_star(curve: DataFrame) -> DataFrame:
    """Add the second difference and mark its first maximum."""
    along = Window.orderBy("i")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bent = curve.withColumn("d2", F.lead("d").over(along) + F.lag("d").over(along) - 2 * F.col("d"))
    # rounded so that the arg-max does not hang on the order sums were taken in
    bend = F.struct(F.round("d2", 12).alias("bend"), (-F.col("i")).alias("minus_i"))
    top = F.max(F.when(F.col("d2").isNotNull(), bend)).over(everything)
    return bent.withColumn("is_star", F.coalesce(F.col("d2").isNotNull() & (top["minus_i"] == -F.col("i")), F.lit(False)))


def prior_from_curve(curve: DataFrame) -> DataFrame:
    """One row: the alpha with the largest second difference."""
    return curve.filter("is_star").select("alpha")
