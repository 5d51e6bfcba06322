"""From raw model scores to classes with a confidence."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puspark.operators.confidence import classify, with_confidence
from puspark.operators.ensemble import ENTITY, assessment_rows, entity_table
from puspark.operators.scan import BLOCK_ROWS
from puspark.operators.threshold import DEFAULT_EPS, DEFAULT_THRESHOLDS
from puspark.plans.prior_estimation import DEFAULT_STEPS, Threshold, calibrate_threshold
from puspark.sources.shared import materialise


class Classification(NamedTuple):
    scored: DataFrame
    alpha: float
    threshold: Threshold
    curve: DataFrame


def classify_pu(
    preds: DataFrame,
    steps: int = DEFAULT_STEPS,
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
    eps: float = DEFAULT_EPS,
    score: str = "score",
    block_rows: int = BLOCK_ROWS,
) -> Classification:
    """Average, calibrate on assessment rows, classify all rows, attach confidence.

    The scores are read and shuffled once: one table of entities with their mean and Beta statistics is
    written, and every later step reads the columns it needs from that.
    """
    entities = materialise(entity_table(preds, score))
    clash = entities.filter("conflict").select("ind_id").limit(1).collect()
    if clash:
        raise ValueError(f"ind_id {clash[0]['ind_id']!r} occurs with differing holdout or label values")
    found = calibrate_threshold(assessment_rows(entities), steps, thresholds, eps, block_rows=block_rows)
    scored = with_confidence(classify(entities, found.threshold), found.threshold).select(
        *ENTITY, "score_mean", "pred_class", "confidence", "conf_status"
    )
    return Classification(scored, found.prior.alpha, found, found.prior.curve)


def classified_entities(preds: DataFrame, **options) -> DataFrame:
    """``classify_pu`` as one table, with the prior and threshold on every row."""
    got = classify_pu(preds, **options)
    return got.scored.withColumns(
        {"alpha": F.lit(got.alpha), "threshold": F.lit(got.threshold.threshold), "matched": F.lit(got.threshold.matched)}
    )
