"""Class of each entity, and the confidence in it: the Beta tail beyond the threshold on the class's side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.functions import beta
from puspark.operators.checks import require_columns


def classify(entities: DataFrame, threshold: float, score: str = "score_mean") -> DataFrame:
    """``pred_class`` 1 where the score is strictly above the threshold."""
    return entities.withColumn("pred_class", (F.col(score) > F.lit(float(threshold))).cast("int"))


def _status() -> Column:
    """Which entities have a Beta fit.

    ``constant``: several scores, all 0 or all 1. ``degenerate``: one score, or equal ones. ``boundary``: some
    scores are exactly 0 or 1, where the likelihood is unbounded.
    """
    low, high = F.col("score_min"), F.col("score_max")
    same = low == high
    edge = (low <= 0) | (high >= 1)
    return (
        F.when((F.col("n") > 1) & same & edge, "constant")
        .when((F.col("n") <= 1) | same, "degenerate")
        .when(edge, "boundary")
        .otherwise("fitted")
    )


def _fitter(threshold: float):
    @F.pandas_udf("shape1 double, shape2 double, confidence double")
    def run(
        mean: pd.Series, var: pd.Series, mean_ln: pd.Series, mean_ln1m: pd.Series, pred_class: pd.Series, status: pd.Series
    ) -> pd.DataFrame:
        out = np.full((3, len(mean)), np.nan)
        fitted = (status == "fitted").to_numpy()
        if fitted.any():
            m, v, la, lb = (c.to_numpy(dtype=np.float64)[fitted] for c in (mean, var, mean_ln, mean_ln1m))
            with np.errstate(all="ignore"):
                a, b = beta.fit(m, v, la, lb)
                tail = beta.upper_tail(a, b, threshold, pred_class.to_numpy()[fitted] == 1)
            out[:, fitted] = a, b, tail
        return pd.DataFrame({"shape1": out[0], "shape2": out[1], "confidence": out[2]})

    return run


def with_confidence(classified: DataFrame, threshold: float) -> DataFrame:
    """Add ``confidence`` and ``conf_status`` (and the fitted shapes) to entities carrying their score statistics."""
    stats = ["score_mean", "score_var", "mean_ln", "mean_ln1m", "pred_class"]
    require_columns(classified, [*stats, "n", "score_min", "score_max"])
    marked = classified.withColumn("conf_status", F.coalesce(_status(), F.lit("degenerate")))
    fit = _fitter(float(threshold))(*stats, "conf_status")
    fitted = marked.withColumn("_fit", fit)
    nothing = F.lit(float("nan"))
    tail = F.when(F.col("conf_status") == "constant", F.lit(1.0)).otherwise(F.nullif(F.col("_fit.confidence"), nothing))
    return fitted.withColumns(
        {"shape1": F.nullif(F.col("_fit.shape1"), nothing), "shape2": F.nullif(F.col("_fit.shape2"), nothing), "confidence": tail}
    ).drop("_fit")
