"""Class prior of the unlabeled entities from the ratio of two score densities (DEDPUL, Ivanov, ICMLA 2020)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from puspark.operators.density import (
    UNLABELED,
    KdePlan,
    collect_plan,
    density_at,
    kde_grid,
    kde_plan,
    linear_bin,
    raw_ratio,
    split_scores,
)
from puspark.operators.ordered import monotone_ratio, rolling_median
from puspark.operators.prior import prior_curve, prior_from_curve
from puspark.operators.scan import BLOCK_ROWS, bucket_edges
from puspark.operators.threshold import DEFAULT_EPS, DEFAULT_THRESHOLDS, pick_threshold, threshold_sweep
from puspark.sources.shared import materialise

DEFAULT_STEPS = 1000


class Densities(NamedTuple):
    plans: dict[int, KdePlan]
    scores: DataFrame
    at_unlabeled: DataFrame


class PriorEstimate(NamedTuple):
    alpha: float
    curve: DataFrame
    scores: DataFrame


class Threshold(NamedTuple):
    threshold: float
    share: float
    matched: bool
    prior: PriorEstimate


def densities(entities: DataFrame, label_col: str = "known_pos", score_col: str = "score_mean") -> Densities:
    """Both densities at every distinct unlabeled score."""
    plans = collect_plan(kde_plan(entities, label_col, score_col))
    # the one shuffle of the scores; binning, densities, positions and the threshold sweep all read its result
    scores = materialise(split_scores(entities, label_col, score_col))
    grid = kde_grid(entities.sparkSession, linear_bin(scores, plans), plans)
    unlabeled = scores.filter(scores["label"] == UNLABELED).drop("label")
    return Densities(plans, scores, density_at(unlabeled, grid, plans))


def monotone(dens: Densities, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Raw ratio with positions and the partial running maximum."""
    unlabeled = dens.plans[UNLABELED]
    scores = dens.scores.filter(dens.scores["label"] == UNLABELED)
    edges = bucket_edges(scores, "y", unlabeled.n, block_rows)
    return monotone_ratio(raw_ratio(dens.at_unlabeled), unlabeled.mean, edges)


def density_ratio(dens: Densities, denom: float = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs (rn, n_rows, r) of the monotone, smoothed ratio along the unlabeled scores."""
    n = dens.plans[UNLABELED].n
    # written once, as the median reads it in several passes
    runs = materialise(monotone(dens, block_rows).select("rn", "n_rows", "r"))
    return rolling_median(runs, n, denom, block_rows)


def estimate_prior(
    entities: DataFrame,
    steps: int = DEFAULT_STEPS,
    label_col: str = "known_pos",
    score_col: str = "score_mean",
    block_rows: int = BLOCK_ROWS,
) -> PriorEstimate:
    """Share of positives among the unlabeled rows of ``entities``, with the curve it was read from."""
    dens = densities(entities, label_col, score_col)
    curve = materialise(prior_curve(density_ratio(dens, block_rows=block_rows), steps))
    return PriorEstimate(prior_from_curve(curve).first()["alpha"], curve, dens.scores)


def calibrate_threshold(
    entities: DataFrame,
    steps: int = DEFAULT_STEPS,
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
    eps: float = DEFAULT_EPS,
    label_col: str = "known_pos",
    score_col: str = "score_mean",
    block_rows: int = BLOCK_ROWS,
) -> Threshold:
    """The threshold above which the share of unlabeled scores is within ``eps`` of the class prior."""
    prior = estimate_prior(entities, steps, label_col, score_col, block_rows)
    unlabeled = prior.scores.filter(prior.scores["label"] == UNLABELED)
    row = pick_threshold(threshold_sweep(unlabeled, thresholds), prior.alpha, eps).first()
    return Threshold(row["threshold"], row["share"], row["matched"], prior)
