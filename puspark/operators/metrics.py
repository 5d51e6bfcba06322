"""Recall on assessment rows and specificity on verified negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1)).cast("double")


def _share(truth: int, within: Column) -> Column:
    """Of the rows of class ``truth`` with a usable prediction, the share predicted as such."""
    known = within & (F.col("known_pos") == truth) & F.col("pred_class").isin(0, 1)
    return F.try_divide(_count(known & (F.col("pred_class") == truth)), _count(known))


def recall(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Recall of the positive class over all rows."""
    require_columns(df, ["known_pos", "pred_class", *group_cols])
    return df.groupBy(*group_cols).agg(_share(1, F.lit(True)).alias("recall"))


def pu_metrics(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Recall over assessment rows and specificity over held-out verified negatives, in one pass."""
    require_columns(df, ["holdout", "known_pos", "known_neg", "pred_class", *group_cols])
    return df.groupBy(*group_cols).agg(
        _share(1, F.col("holdout") == 0).alias("recall"),
        _share(0, (F.col("holdout") == 1) & (F.col("known_neg") == 1)).alias("specif"),
    )
