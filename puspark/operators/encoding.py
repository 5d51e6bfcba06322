"""Numbers for names, learned on analysis sets only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns
from puspark.operators.joins import HOT_ROWS, skewed_join
from puspark.sources.shared import materialise

#: Rows of the overall rate that every category counts besides its own.
PRIOR_ROWS = 20.0


def target_rates(folded: DataFrame, column: str, label: str, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """(common_seed, fold_id, category, rate, n): for every fold and category the share of positives among the rows of all
    other folds, drawn to these rows' overall share by ``prior_rows`` rows; ``n`` counts the category's labelled rows of the seed.

    ``folded`` holds each row once per seed with its fold. One aggregate counts rows and positives per fold; an analysis
    set's counts are the seed's less the fold's. Null is a category; categories that only the fold has get the overall
    share. Rows without a label count for nothing.
    """
    require_columns(folded, ["common_seed", "fold_id", column, label])
    counted = [F.count(label).alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("p")]
    own = materialise(folded.groupBy("common_seed", "fold_id", F.col(column).alias("category")).agg(*counted))
    folds = own.groupBy("common_seed", "fold_id").agg(F.sum("n").alias("_fold_n"), F.sum("p").alias("_fold_p"))
    seed = Window.partitionBy("common_seed")  # as many rows as folds
    folds = folds.select(
        "common_seed",
        "fold_id",
        (F.sum("_fold_n").over(seed) - F.col("_fold_n")).alias("_rest_n"),
        (F.sum("_fold_p").over(seed) - F.col("_fold_p")).alias("_rest_p"),
    )
    per_category = own.groupBy("common_seed", "category").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.map_from_entries(F.collect_list(F.struct("fold_id", F.struct("n", "p")))).alias("_own")
    )
    each = per_category.join(F.broadcast(materialise(folds)), "common_seed").withColumn("_mine", F.try_element_at("_own", F.col("fold_id")))

    def rest(name: str) -> Column:
        return F.col(name) - F.coalesce(F.col(f"_mine.{name}"), F.lit(0))

    overall = F.when(F.col("_rest_n") > 0, F.col("_rest_p") / F.col("_rest_n")).otherwise(F.lit(0.0))
    rate = (rest("p") + F.lit(float(prior_rows)) * overall) / (rest("n") + F.lit(float(prior_rows)))
    return each.select("common_seed", "fold_id", "category", rate.alias("rate"), "n")


def with_target_rates(
    folded: DataFrame, columns: Sequence[str], label: str, prior_rows: float = PRIOR_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``folded`` with a ``<column>_rate`` per column: what the row's own fold does not know of it, so that no label of an
    assessed row is in its features. Hot categories are joined by broadcast, all others by shuffle."""
    for column in columns:
        rates = target_rates(folded, column, label, prior_rows)
        name = F.xxhash64("common_seed", "fold_id", F.col("category").isNull(), "category")
        rates = materialise(rates.select(name.alias("_place"), F.col("common_seed").alias("_s"), F.col("fold_id").alias("_f"), "category", F.col("rate").alias(f"{column}_rate"), "n"))
        placed = folded.withColumn("_place", F.xxhash64("common_seed", "fold_id", F.col(column).isNull(), column))
        joined = skewed_join(placed, rates, "_place", "n", hot_rows)
        same = F.col(column).eqNullSafe(F.col("category")) & (F.col("_s") == F.col("common_seed")) & (F.col("_f") == F.col("fold_id"))
        folded = joined.filter(same).drop("_place", "_s", "_f", "category", "n")
    return folded
