"""The decision threshold whose share of positives among the unlabeled matches the class prior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns
from puspark.operators.scan import double_array, with_bucket

DEFAULT_THRESHOLDS = tuple(i * 0.01 for i in range(100))
DEFAULT_EPS = 0.01


def threshold_sweep(unlabeled: DataFrame, thresholds: Sequence[float] = DEFAULT_THRESHOLDS) -> DataFrame:
    """(idx, threshold, n_above, share): how many unlabeled scores lie strictly above each threshold.

    One pass counts scores by the number of distinct thresholds below them; the sweep accumulates those counts.
    ``unlabeled`` has one row per score ``y``, or per distinct score with its ``n_rows``.
    """
    require_columns(unlabeled, ["y"])
    if not thresholds:
        raise ValueError("no thresholds given")
    spark = unlabeled.sparkSession
    levels = sorted(set(float(t) for t in thresholds))
    weight = F.col("n_rows") if "n_rows" in unlabeled.columns else F.lit(1)
    # thresholds at or above y are negated edges at or below -y: this keeps the comparison strict
    turned = with_bucket(unlabeled.withColumn("_minus", -F.col("y")), "_minus", [-t for t in reversed(levels)], "_not_below")
    counts = turned.groupBy((F.lit(len(levels)) - F.col("_not_below")).cast("int").alias("level")).agg(
        F.sum(weight).alias("n")
    )
    known = (
        spark.range(1)
        .select(F.posexplode(double_array(thresholds)).alias("idx", "threshold"))
        .withColumn("level", F.dense_rank().over(Window.orderBy("threshold")))
    )
    ladder = spark.range(len(levels) + 1).select(F.col("id").cast("int").alias("level")).join(counts, "level", "left")
    from_top = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = ladder.select(
        "level",
        F.coalesce(F.sum("n").over(from_top), F.lit(0)).alias("n_above"),
        F.sum("n").over(everything).alias("_total"),
    )
    return known.join(above, "level").select(
        "idx", "threshold", "n_above", (F.col("n_above") / F.col("_total")).alias("share")
    )


def pick_threshold(sweep: DataFrame, alpha: float, eps: float = DEFAULT_EPS) -> DataFrame:
    """One row (threshold, share, matched): the last listed threshold whose share is within ``eps`` of alpha.

    Without such a threshold the first listed one is given and ``matched`` is false.
    """
    near = F.abs(F.col("share") - F.lit(float(alpha))) < eps
    hit = F.max(F.when(near, F.struct("idx", "threshold", "share"))).alias("hit")
    fallback = F.min(F.struct("idx", "threshold", "share")).alias("fallback")
    chosen = F.coalesce("hit", "fallback")
    return sweep.agg(hit, fallback).select(
        chosen["threshold"].alias("threshold"), chosen["share"].alias("share"), F.col("hit").isNotNull().alias("matched")
    )
