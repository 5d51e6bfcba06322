"""Binned kernel densities of positive and unlabeled scores, read off at the unlabeled scores."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns
from puspark.operators.scan import double_array

# fixed values: grid size and support of the binned normal-kernel estimate
GRID_POINTS = 401
SUPPORT = 4.0

POSITIVE, UNLABELED = 1, 0


class KdePlan(NamedTuple):
    """Where one class's grid lies and how wide its kernel is."""

    label: int
    n: int
    mean: float
    bandwidth: float
    start: float
    step: float
    reach: int

    @property
    def relative_step(self) -> float:
        """Grid step in bandwidths."""
        return self.step / self.bandwidth

    @property
    def kernel_mass(self) -> float:
        """Divisor that gives the kernel, summed over its grid points and all scores, mass one."""
        side = sum(math.exp(-0.5 * (j * self.relative_step) ** 2) for j in range(1, self.reach + 1))
        return (1 + 2 * side) * self.step * self.n


def split_scores(entities: DataFrame, label_col: str = "known_pos", score_col: str = "score_mean") -> DataFrame:
    """(label, y, n_rows): how often each score occurs among positives and among unlabeled entities.

    The densities, the ratio and everything derived from it depend on the score only, so equal scores are
    counted once here and carried as a weight from then on.
    """
    require_columns(entities, [label_col, score_col])
    usable = F.col(label_col).isin(POSITIVE, UNLABELED) & F.col(score_col).isNotNull() & ~F.isnan(score_col)
    return (
        entities.filter(usable)
        .groupBy(F.col(label_col).cast("int").alias("label"), F.col(score_col).alias("y"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def kde_plan(entities: DataFrame, label_col: str = "known_pos", score_col: str = "score_mean") -> DataFrame:
    """One row per class: size, mean, bandwidth, grid start, grid step and kernel reach in grid steps."""
    require_columns(entities, [label_col, score_col])
    usable = F.col(label_col).isin(POSITIVE, UNLABELED) & F.col(score_col).isNotNull() & ~F.isnan(score_col)
    stats = (
        entities.filter(usable)
        .groupBy(F.col(label_col).cast("int").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score_col).alias("mean"),
            F.stddev_samp(score_col).alias("sd"),
            F.min(score_col).alias("low"),
            F.max(score_col).alias("high"),
        )
    )
    # normal-reference rule of the binned estimator
    scale = (1 / (4 * math.pi)) ** 0.1
    width = F.lit(scale) * F.pow(F.lit(243.0) / (35 * F.col("n")), F.lit(0.2)) * F.col("sd")
    planned = stats.withColumn("bandwidth", width).withColumn("start", F.col("low") - SUPPORT * F.col("bandwidth"))
    step = (F.col("high") + SUPPORT * F.col("bandwidth") - F.col("start")) / (GRID_POINTS - 1)
    reach = F.least(F.floor(F.try_divide(F.lit(SUPPORT) * F.col("bandwidth"), F.col("step"))), F.lit(GRID_POINTS))
    return planned.withColumn("step", step).select(
        "label", "n", "mean", "bandwidth", "start", "step", reach.cast("int").alias("reach")
    )


def collect_plan(plan: DataFrame) -> dict[int, KdePlan]:
    """The two plan rows as numbers, checked."""
    plans = {row["label"]: KdePlan(**row.asDict()) for row in plan.collect()}
    for label, name in ((POSITIVE, "positive"), (UNLABELED, "unlabeled")):
        got = plans.get(label)
        if got is None or got.n < 2:
            raise ValueError(f"at least two {name} scores are needed")
        if not got.bandwidth or not got.bandwidth > 0:
            raise ValueError(f"all {name} scores are equal; their density is undefined")
    return plans


def _by_label(plans: dict[int, KdePlan], field: str) -> Column:
    return F.when(F.col("label") == POSITIVE, F.lit(getattr(plans[POSITIVE], field))).otherwise(
        F.lit(getattr(plans[UNLABELED], field))
    )


def linear_bin(scores: DataFrame, plans: dict[int, KdePlan]) -> DataFrame:
    """(label, bin, weight): each score shares its weight between the two grid points around it.

    Rows are summed per left-hand grid point first (count and total remainder); the second grid point is split
    off afterwards, on at most 401 rows per class.
    """
    place = (F.col("y") - _by_label(plans, "start")) / _by_label(plans, "step")
    left = F.floor(place).cast("int")
    per_cell = scores.groupBy("label", left.alias("cell")).agg(
        F.sum("n_rows").cast("double").alias("_n"), F.sum((place - left) * F.col("n_rows")).alias("_rest")
    )
    shares = F.array(
        F.struct(F.col("cell").alias("bin"), (F.col("_n") - F.col("_rest")).alias("weight")),
        F.struct((F.col("cell") + 1).alias("bin"), F.col("_rest").alias("weight")),
    )
    return per_cell.select("label", F.inline(shares)).groupBy("label", "bin").agg(F.sum("weight").alias("weight"))


def kde_grid(spark: SparkSession, binned: DataFrame, plans: dict[int, KdePlan]) -> DataFrame:
    """(label, bin, x, f): the density at every grid point, by spreading each bin over the kernel's reach."""
    reach = _by_label(plans, "reach")
    spread = binned.select("label", "bin", "weight", F.explode(F.sequence(-reach, reach)).alias("_off"))
    lag = F.col("_off") * _by_label(plans, "relative_step")
    falls = spread.select(
        "label",
        (F.col("bin") + F.col("_off")).alias("bin"),
        (F.col("weight") * F.exp(-0.5 * lag * lag) / _by_label(plans, "kernel_mass")).alias("f"),
    ).filter(F.col("bin").between(0, GRID_POINTS - 1))
    points = spark.range(GRID_POINTS).select(
        F.explode(F.array(F.lit(POSITIVE), F.lit(UNLABELED))).alias("label"),
        F.col("id").cast("int").alias("bin"),
        F.lit(0.0).alias("f"),
    )
    return (
        falls.unionByName(points)
        .groupBy("label", "bin")
        .agg(F.sum("f").alias("f"))
        .select("label", "bin", (_by_label(plans, "start") + F.col("bin") * _by_label(plans, "step")).alias("x"), "f")
    )


def density_at(unlabeled: DataFrame, grid: DataFrame, plans: dict[int, KdePlan]) -> DataFrame:
    """Add ``f_pos`` and ``f_unl``: both densities at ``y``, linear between grid points, flat beyond the ends.

    The grid is worked out once. Its 401 values per class go into the expression as literals and the cell of a score
    is computed, so the scores are read in one narrow pass without a join.
    """
    values = {(row["label"], row["bin"]): row["f"] for row in grid.collect()}
    found = {}
    for label, name in ((POSITIVE, "f_pos"), (UNLABELED, "f_unl")):
        p = plans[label]
        table = double_array([values[label, b] for b in range(GRID_POINTS)])
        place = (F.col("y") - F.lit(p.start)) / F.lit(p.step)
        cell = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(GRID_POINTS - 2)).cast("int")
        part = F.least(F.greatest(place - cell, F.lit(0.0)), F.lit(1.0))
        low, high = F.get(table, cell), F.get(table, cell + 1)
        found[name] = low + (high - low) * part
    return unlabeled.withColumns(found)


def raw_ratio(densities: DataFrame) -> DataFrame:
    """Add ``r``, positive over unlabeled density. Every unlabeled score carries its own kernel mass, so a missing ratio
    is an error."""
    r = F.try_divide("f_pos", "f_unl")
    missing = F.raise_error(F.lit("the ratio of the densities is missing at a score"))
    return densities.withColumn("r", F.when(r.isNull() | F.isnan(r), missing).otherwise(r))
