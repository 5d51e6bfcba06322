"""Preconditions, raised before any work is started."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; have: {', '.join(df.columns)}")


def require_unique(df: DataFrame, key: str) -> None:
    """One row per key. Partial counts are combined before the shuffle, so a repeated key stays cheap."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][key]!r} is on {repeated[0]['n']} rows; one row is expected")
