"""Positive-unlabeled classification on Spark DataFrames."""

from puspark.operators.balance import balanced_group_folds, numeric_strata
from puspark.operators.confidence import classify, with_confidence
from puspark.operators.density import density_at, kde_grid, kde_plan, linear_bin, raw_ratio, split_scores
from puspark.operators.design import Scale, maximin_grid
from puspark.operators.encoding import target_rates, with_target_rates
from puspark.operators.ensemble import assessment_rows, beta_moments, ensemble_mean, entity_table, score_stats
from puspark.operators.metrics import pu_metrics, recall
from puspark.operators.ordered import expand_runs, partial_running_max, rolling_median, with_position
from puspark.operators.prior import prior_curve, prior_from_curve
from puspark.operators.sampling import (
    assign_folds,
    data_ranges,
    downsample,
    downsample_bags,
    downsample_sets,
    explicit_grid,
    folds_for,
    latin_hypercube,
    make_bags,
    split,
    with_folds,
)
from puspark.operators.splits import bootstrap_splits, members, monte_carlo_splits, repeated_folds
from puspark.operators.threshold import pick_threshold, threshold_sweep
from puspark.operators.tuning import auc_by_fold, auc_summary, best_config, grouped_auc, summarise_tuning
from puspark.plans.classification import classified_entities, classify_pu
from puspark.plans.prior_estimation import calibrate_threshold, densities, density_ratio, estimate_prior
from puspark.plans.training import draw_samples, fit_models, fit_predict_cv, model_keys, score_rows, tune_cv
from puspark.sources.shared import workspace

__all__ = [
    "Scale",
    "assessment_rows",
    "assign_folds",
    "auc_by_fold",
    "auc_summary",
    "balanced_group_folds",
    "best_config",
    "beta_moments",
    "bootstrap_splits",
    "calibrate_threshold",
    "classified_entities",
    "classify",
    "classify_pu",
    "data_ranges",
    "densities",
    "density_at",
    "density_ratio",
    "downsample",
    "downsample_bags",
    "downsample_sets",
    "draw_samples",
    "ensemble_mean",
    "entity_table",
    "estimate_prior",
    "expand_runs",
    "explicit_grid",
    "fit_models",
    "fit_predict_cv",
    "folds_for",
    "grouped_auc",
    "kde_grid",
    "kde_plan",
    "latin_hypercube",
    "linear_bin",
    "make_bags",
    "maximin_grid",
    "members",
    "model_keys",
    "monte_carlo_splits",
    "numeric_strata",
    "partial_running_max",
    "pick_threshold",
    "prior_curve",
    "prior_from_curve",
    "pu_metrics",
    "raw_ratio",
    "recall",
    "repeated_folds",
    "rolling_median",
    "score_rows",
    "score_stats",
    "split",
    "split_scores",
    "summarise_tuning",
    "target_rates",
    "threshold_sweep",
    "tune_cv",
    "with_confidence",
    "with_folds",
    "with_position",
    "with_target_rates",
    "workspace",
]
