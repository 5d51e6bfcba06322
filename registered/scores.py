"""Queries on order scores: tuning summary, class prior, threshold, classes, confidence, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import puspark as pu
from puspark.operators.density import UNLABELED, collect_plan
from puspark.plans.prior_estimation import monotone
from puspark.sources import materialise, quantity_predictions, tuning_predictions


# The *_blocks queries compute the same rows with small blocks, so that the forms meant for long sequences and large
# groups are compared as well: with windows of n / 20 positions they reach beyond many blocks already on small tables.
SMALL_BLOCK = 100


def rounded(column: str, digits: int = 6) -> Column:
    return (F.round(column, digits) + F.lit(0.0)).alias(column)


def _assessment(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of the assessment rows, averaged once: the estimates below take several passes over them."""
    return pu.assessment_rows(materialise(pu.ensemble_mean(quantity_predictions(spark, folder))))


def auc_by_fold(spark, folder):
    auc = pu.auc_by_fold(tuning_predictions(spark, folder))
    return auc.select("common_seed", "fold_id", "config", rounded("auc", 9))


def auc_by_fold_blocks(spark, folder):
    auc = pu.auc_by_fold(tuning_predictions(spark, folder), SMALL_BLOCK)
    return auc.select("common_seed", "fold_id", "config", rounded("auc", 9))


def auc_summary(spark, folder):
    summary = pu.summarise_tuning(tuning_predictions(spark, folder)).auc
    return summary.select("common_seed", "config", rounded("mean_auc", 9), rounded("min_auc", 9))


def best_config(spark, folder):
    return pu.summarise_tuning(tuning_predictions(spark, folder)).best


def ensemble_mean(spark, folder):
    means = pu.ensemble_mean(quantity_predictions(spark, folder))
    return pu.assessment_rows(means).select("ind_id", "holdout", "known_pos", "known_neg", rounded("score_mean", 9))


def kde_plan(spark, folder):
    plan = pu.kde_plan(_assessment(spark, folder))
    return plan.select("label", "n", *[rounded(c, 9) for c in ("mean", "bandwidth", "start", "step")], "reach")


def _binned(spark, folder):
    entities = _assessment(spark, folder)
    plans = collect_plan(pu.kde_plan(entities))
    return plans, pu.linear_bin(pu.split_scores(entities), plans)


def kde_binned(spark, folder):
    return _binned(spark, folder)[1].select("label", "bin", rounded("weight"))


def kde_grid(spark, folder):
    plans, binned = _binned(spark, folder)
    return pu.kde_grid(spark, binned, plans).select("label", "bin", rounded("x"), rounded("f"))


def _per_score(df: DataFrame, *values: str) -> DataFrame:
    """One row per score: equal means may differ in the last bit, as sums are taken in any order."""
    return df.groupBy((F.round("y", 9) + F.lit(0.0)).alias("y")).agg(
        F.sum("n_rows").alias("n_rows"), *[(F.round(F.avg(v), 6) + F.lit(0.0)).alias(v) for v in values]
    )


def density_at_unlabeled(spark, folder):
    return _per_score(pu.densities(_assessment(spark, folder)).at_unlabeled, "f_pos", "f_unl")


def density_ratio_raw(spark, folder):
    return _per_score(pu.raw_ratio(pu.densities(_assessment(spark, folder)).at_unlabeled), "r")


def ratio_monotone(spark, folder):
    return _per_score(monotone(pu.densities(_assessment(spark, folder))), "r")


def ratio_monotone_blocks(spark, folder):
    return _per_score(monotone(pu.densities(_assessment(spark, folder)), SMALL_BLOCK), "r")


def ratio_smoothed(spark, folder):
    dens = pu.densities(_assessment(spark, folder))
    return pu.expand_runs(pu.density_ratio(dens)).select("rn", rounded("r"))


def ratio_smoothed_blocks(spark, folder):
    dens = pu.densities(_assessment(spark, folder))
    return pu.expand_runs(pu.density_ratio(dens, block_rows=SMALL_BLOCK)).select("rn", rounded("r"))


def prior_curve(spark, folder):
    curve = pu.estimate_prior(_assessment(spark, folder)).curve
    return curve.select("i", rounded("alpha", 9), rounded("d"), rounded("d2"), "is_star")


def prior_estimate(spark, folder):
    return pu.prior_from_curve(pu.estimate_prior(_assessment(spark, folder)).curve).select(rounded("alpha", 9))


def threshold_sweep(spark, folder):
    scores = pu.split_scores(_assessment(spark, folder)).filter(F.col("label") == UNLABELED)
    return pu.threshold_sweep(scores).select("idx", rounded("threshold"), "n_above", rounded("share", 9))


def threshold_pick(spark, folder):
    prior = pu.estimate_prior(_assessment(spark, folder))
    sweep = pu.threshold_sweep(prior.scores.filter(F.col("label") == UNLABELED))
    return pu.pick_threshold(sweep, prior.alpha).select(rounded("threshold"), rounded("share", 9), "matched")


def classify(spark, folder):
    entities = materialise(pu.ensemble_mean(quantity_predictions(spark, folder)))
    found = pu.calibrate_threshold(pu.assessment_rows(entities))
    return pu.classify(entities, found.threshold).select(
        "ind_id", "holdout", "known_pos", "known_neg", rounded("score_mean", 9), "pred_class"
    )


def beta_moments(spark, folder):
    stats = pu.beta_moments(pu.score_stats(quantity_predictions(spark, folder)))
    # shapes of near-equal scores run into the thousands; their relative size is what is reproducible
    return stats.select(
        "ind_id",
        "n",
        *[rounded(c, 8) for c in ("score_mean", "score_min", "score_max", "mean_ln", "mean_ln1m")],
        (F.round(F.ln("shape1"), 7) + F.lit(0.0)).alias("ln_shape1"),
        (F.round(F.ln("shape2"), 7) + F.lit(0.0)).alias("ln_shape2"),
    )


def confidence(spark, folder):
    got = pu.classified_entities(quantity_predictions(spark, folder))
    return got.select(
        "ind_id", "pred_class", rounded("confidence"), "conf_status", rounded("alpha"), rounded("threshold")
    )


def _classified(spark, folder):
    return pu.classify_pu(quantity_predictions(spark, folder)).scored


def recall_all(spark, folder):
    return pu.recall(_classified(spark, folder)).select(rounded("recall", 9))


def pu_metrics(spark, folder):
    return pu.pu_metrics(_classified(spark, folder)).select(rounded("recall", 9), rounded("specif", 9))


def pu_metrics_by_group(spark, folder):
    grouped = _classified(spark, folder).withColumn("part", (F.col("ind_id") % 7).cast("int"))
    return pu.pu_metrics(grouped, ["part"]).select("part", rounded("recall", 9), rounded("specif", 9))


QUERIES = {
    f.__name__: f
    for f in (
        auc_by_fold,
        auc_by_fold_blocks,
        auc_summary,
        best_config,
        ensemble_mean,
        kde_plan,
        kde_binned,
        kde_grid,
        density_at_unlabeled,
        density_ratio_raw,
        ratio_monotone,
        ratio_monotone_blocks,
        ratio_smoothed,
        ratio_smoothed_blocks,
        prior_curve,
        prior_estimate,
        threshold_sweep,
        threshold_pick,
        classify,
        beta_moments,
        confidence,
        recall_all,
        pu_metrics,
        pu_metrics_by_group,
    )
}
