"""Grouped ROC-AUC, its summary over folds, and the best config per seed."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns
from puspark.operators.scan import BLOCK_ROWS, Scan, bucket_edges, two_level_scan, with_bucket
from puspark.sources.shared import materialise

PER_ROW = ("score", "bag", "known_pos", "ind_id", "counter")  # columns that do not identify a config


class TuningSummary(NamedTuple):
    auc: DataFrame
    best: DataFrame


def grouped_auc(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "known_pos",
    score: str = "score",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Area under the ROC curve per group of ``keys``; ties count one half, NULL when a class is missing.

    The rows are read once and counted per distinct score; the counts are scanned in score buckets. So neither a
    huge group nor a score shared by many rows lands in one task.
    """
    require_columns(df, [*keys, label, score])
    usable = F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1)
    # unusable rows count for neither class but keep their group in the result
    tidy = df.select(
        *keys,
        F.when(usable, F.col(score)).otherwise(0.0).alias("_score"),
        F.when(usable, F.col(label)).alias("_label"),
    )
    counted = materialise(
        tidy.groupBy(*keys, "_score").agg(
            F.count(F.when(F.col("_label") == 1, 1)).alias("_pos"), F.count(F.when(F.col("_label") == 0, 1)).alias("_neg")
        )
    )
    edges = bucket_edges(counted, "_score", block_rows=block_rows)
    placed = with_bucket(counted, "_score", edges, "_bucket")
    ranked = two_level_scan(placed, [Scan("_below", F.col("_neg"), "sum", -1)], ["_score"], "_bucket", keys)
    pos, neg, below = (F.col(c).cast("double") for c in ("_pos", "_neg", "_below"))
    per_group = ranked.groupBy(*keys).agg(
        F.sum(pos * (below + neg / 2)).alias("_won"), F.sum(pos).alias("_p"), F.sum(neg).alias("_n")
    )
    area = F.try_divide(F.col("_won"), F.col("_p") * F.col("_n"))
    return per_group.select(*keys, area.alias("auc"))


def auc_by_fold(tune_preds: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """AUC per (seed, fold, config); the bags of a seed are pooled."""
    require_columns(tune_preds, [*PER_ROW, "common_seed", "fold_id"])
    return grouped_auc(tune_preds, [c for c in tune_preds.columns if c not in PER_ROW], block_rows=block_rows)


def auc_summary(fold_auc: DataFrame) -> DataFrame:
    """Mean and minimum over folds; NULL as soon as one fold has no AUC."""
    keys = [c for c in fold_auc.columns if c not in ("fold_id", "auc")]
    complete = F.count("auc") == F.count(F.lit(1))
    return fold_auc.groupBy(*keys).agg(
        F.when(complete, F.avg("auc")).alias("mean_auc"), F.when(complete, F.min("auc")).alias("min_auc")
    )


def best_config(summary: DataFrame) -> DataFrame:
    """The config with the highest mean AUC of each seed; ties go to the smallest config."""
    config = [c for c in summary.columns if c not in ("common_seed", "mean_auc", "min_auc")]
    # rounded so that ties do not depend on the order sums were taken in
    first = Window.partitionBy("common_seed").orderBy(F.desc_nulls_last(F.round("mean_auc", 12)), *config)
    return summary.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").select("common_seed", *config)


def summarise_tuning(tune_preds: DataFrame, block_rows: int = BLOCK_ROWS) -> TuningSummary:
    summary = auc_summary(auc_by_fold(tune_preds, block_rows))
    return TuningSummary(summary, best_config(summary))
