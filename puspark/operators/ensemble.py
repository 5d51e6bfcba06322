"""Scores of one entity put together: its mean, and what the Beta fit needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns

ENTITY = ("ind_id", "holdout", "known_pos", "known_neg")


def _usable(score: str) -> Column:
    """The score, with NaN as missing (``avg`` does not skip NaN)."""
    return F.when(~F.isnan(score), F.col(score))


def ensemble_mean(preds: DataFrame, score: str = "score") -> DataFrame:
    """Mean score per entity row over all models; missing scores are left out."""
    require_columns(preds, [*ENTITY, score])
    return preds.groupBy(*ENTITY).agg(F.avg(_usable(score)).alias("score_mean"))


def assessment_rows(entities: DataFrame) -> DataFrame:
    return entities.filter("holdout = 0")


def _moments(score: str) -> list[Column]:
    s = _usable(score)
    inside = F.when((s > 0) & (s < 1), s)
    return [
        F.count(s).alias("n"),
        F.min(s).alias("score_min"),
        F.max(s).alias("score_max"),
        F.var_pop(s).alias("score_var"),
        F.avg(F.ln(inside)).alias("mean_ln"),
        F.avg(F.log1p(-inside)).alias("mean_ln1m"),
    ]


def score_stats(preds: DataFrame, score: str = "score") -> DataFrame:
    """Per entity, the sufficient statistics of a Beta likelihood over all its scores."""
    require_columns(preds, ["ind_id", score])
    return preds.groupBy("ind_id").agg(F.avg(_usable(score)).alias("score_mean"), *_moments(score))


def entity_table(preds: DataFrame, score: str = "score") -> DataFrame:
    """``ensemble_mean`` and ``score_stats`` in one shuffle, plus ``conflict``: the entity has differing labels.

    Grouping by entity alone and comparing the labels' extremes finds entities that would be on several
    averaged rows, without a second shuffle. All aggregates combine before the shuffle, so an entity with a
    large share of all scores is no hot spot.
    """
    require_columns(preds, [*ENTITY, score])
    labels = ENTITY[1:]
    rows = F.count(F.lit(1))
    differs = F.lit(False)
    for c in labels:
        differs = differs | F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ~F.count(c).isin(F.lit(0), rows)
    return preds.groupBy("ind_id").agg(
        *[F.min(c).alias(c) for c in labels],
        F.avg(_usable(score)).alias("score_mean"),
        *_moments(score),
        differs.alias("conflict"),
    )


def beta_moments(stats: DataFrame) -> DataFrame:
    """Add moment estimates of the Beta shapes; NULL where the scores do not vary."""
    mean, spread = F.col("score_mean"), F.try_divide(F.col("score_mean") * (1 - F.col("score_mean")), F.col("score_var")) - 1
    varies = (F.col("n") > 1) & (F.col("score_min") < F.col("score_max"))
    return stats.withColumns(
        {"shape1": F.when(varies, mean * spread), "shape2": F.when(varies, (1 - mean) * spread)}
    )
