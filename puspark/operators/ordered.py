"""Operators on a sequence: positions, partial running maximum, running median.

A sequence is a table of runs (``rn``, ``n_rows``, value): the value holds at positions ``rn`` to
``rn + n_rows - 1``, counted from 1. A table with one row per position is the case ``n_rows = 1``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from puspark.functions.medians import to_runs, window_kth
from puspark.operators.checks import require_columns
from puspark.operators.scan import BLOCK_ROWS, Scan, block_size, bucket_edges, two_level_scan, with_bucket
from puspark.sources.shared import materialise

RUNS = "rn long, n_rows long, r double"


def monotone_ratio(
    ratio: DataFrame, mean_y: float, edges: Sequence[float] = (), y: str = "y", r: str = "r", weight: str = "n_rows"
) -> DataFrame:
    """Positions along ``y`` and the partial running maximum of ``r``, in one scan over score buckets."""
    scans = [Scan("_before", F.col(weight), "sum", -1), _upper_scan(y, r, mean_y)]
    scanned = two_level_scan(with_bucket(ratio, y, edges, "_bucket"), scans, [y], "_bucket")
    return _floor_upper(scanned, y, r, mean_y).withColumn("rn", F.col("_before") + 1).drop("_before", "_bucket")


def with_position(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs along ``order``: one row per distinct value, its first position ``rn`` and its number of rows ``n_rows``."""
    counted = materialise(df.groupBy(order).agg(F.count(F.lit(1)).alias("n_rows")))
    placed = with_bucket(counted, order, bucket_edges(counted, order, block_rows=block_rows), "_bucket")
    scanned = two_level_scan(placed, [Scan("_before", F.col("n_rows"), "sum", -1)], [order], "_bucket")
    return scanned.withColumn("rn", F.col("_before") + 1).drop("_before", "_bucket")


def _upper_scan(y: str, r: str, mean_y: float) -> Scan:
    return Scan("_upper", F.when(F.col(y) > mean_y, F.col(r)), "max")


def _floor_upper(scanned: DataFrame, y: str, r: str, mean_y: float) -> DataFrame:
    raised = F.greatest(F.col("_upper"), F.lit(0.0))
    return scanned.withColumn(r, F.when(F.col(y) > mean_y, raised).otherwise(F.col(r))).drop("_upper")


def partial_running_max(
    df: DataFrame,
    r: str = "r",
    y: str = "y",
    position: str = "rn",
    mean_y: float | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Where ``y`` exceeds its mean, ``r`` becomes the largest ``r`` met so far among such rows, at least 0."""
    require_columns(df, [r, y, position])
    if mean_y is None:
        weight = F.col("n_rows") if "n_rows" in df.columns else F.lit(1)
        mean_y = df.agg((F.sum(F.col(y) * weight) / F.sum(weight)).alias("m")).first()["m"]
    placed = df.withColumn("_block", F.floor((F.col(position) - 1) / block_rows))
    scanned = two_level_scan(placed, [_upper_scan(y, r, mean_y)], [position], "_block")
    return _floor_upper(scanned, y, r, mean_y).drop("_block")


def expand_runs(runs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per position. Long runs are first cut into blocks and spread, then repeated."""
    cut = _cut(runs, block_rows).repartition("_block")
    return cut.withColumn("rn", F.explode(F.sequence("rn", F.col("rn") + F.col("n_rows") - 1))).drop("n_rows", "_block")


# --- running median -------------------------------------------------------------------------------------------


def median_window(n: int, denom: float = 20) -> int:
    """Window size for ``n`` values: n / denom, truncated, made odd, at most n."""
    size = int(n / denom)
    size += size % 2 == 0
    return size if size <= n else 1 + 2 * ((n - 1) // 2)


class Windows(NamedTuple):
    """Odd-sized windows at positions ``first`` to ``last``; both ends are straight lines in the position."""

    first: int
    last: int
    low: tuple[int, int]
    high: tuple[int, int]

    def bounds(self, i):
        return self.low[0] * i + self.low[1], self.high[0] * i + self.high[1]


def _cut(runs: DataFrame, block_rows: int) -> DataFrame:
    """Runs cut at block borders; block b holds positions b * block_rows + 1 to (b + 1) * block_rows."""
    end = F.col("rn") + F.col("n_rows") - 1
    block = F.explode(F.sequence(F.floor((F.col("rn") - 1) / block_rows), F.floor((end - 1) / block_rows)))
    pieces = runs.withColumn("_end", end).withColumn("_block", block)
    start = F.greatest(F.col("rn"), F.col("_block") * block_rows + 1)
    stop = F.least(F.col("_end"), (F.col("_block") + 1) * block_rows)
    return pieces.withColumn("n_rows", stop - start + 1).withColumn("rn", start).drop("_end")


def _clip(runs: DataFrame, low: int, high: int) -> DataFrame:
    """The part of the sequence at positions ``low`` to ``high``."""
    start = F.greatest(F.col("rn"), F.lit(low))
    stop = F.least(F.col("rn") + F.col("n_rows") - 1, F.lit(high))
    return runs.select(start.alias("rn"), (stop - start + 1).alias("n_rows"), "r").filter("n_rows > 0")


def range_medians(runs: DataFrame, windows: Windows, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Medians of ``windows`` over the sequence ``runs``, as runs; every task holds O(block_rows) values.

    Positions are answered in blocks. All windows of one block share a core of whole blocks; around it lies a
    fringe of a few blocks. A core value can only be one of the block's medians if its rank within the core is
    within the fringe's size of the middle, so of the core only counts below that band, and the distinct values
    in it, reach the task - however long the windows are.
    """
    size = block_rows

    def solve(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        begin = windows.first + int(key[0]) * size
        at = np.arange(begin, min(begin + size - 1, windows.last) + 1)
        low, high = windows.bounds(at)
        low, high = np.broadcast_to(low, at.shape), np.broadcast_to(high, at.shape)
        fringe = rows[rows["kind"] == 0].sort_values("rn")
        core = rows[rows["kind"] == 1]
        skipped = int(rows.loc[rows["kind"] == 2, "n_rows"].sum())
        lengths = fringe["n_rows"].to_numpy()
        ahead = np.cumsum(lengths) - lengths
        places = np.repeat(fringe["rn"].to_numpy() - ahead, lengths) + np.arange(lengths.sum())
        values = np.repeat(fringe["r"].to_numpy(), lengths)
        # fringe before the core, core values, fringe after it: a window is one slice of this
        border = int(np.searchsorted(places, low.max())) if len(core) or skipped else len(places)
        start = np.searchsorted(places, low)
        stop = np.searchsorted(places, high, side="right") + len(core)
        sequence = np.concatenate((values[:border], core["r"].to_numpy(), values[border:]))
        weights = np.ones(len(sequence), dtype=np.int64)
        weights[border : border + len(core)] = core["n_rows"].to_numpy()
        medians = window_kth(sequence, weights, start, stop, (high - low) // 2 - skipped)
        rn, n_rows, r = to_runs(begin, medians)
        return pd.DataFrame({"rn": rn, "n_rows": n_rows, "r": r})

    return block_payload(runs, windows, size).groupBy("q").applyInPandas(solve, RUNS)


def block_payload(runs: DataFrame, windows: Windows, size: int) -> DataFrame:
    """What each block ``q`` of positions is sent: the runs around its core (kind 0) and the core's middle band (1, 2)."""
    blocks = (windows.last - windows.first) // size + 1
    spark = runs.sparkSession
    pieces = _cut(runs, size)

    first = F.lit(windows.first) + F.col("q") * size
    last = F.least(first + size - 1, F.lit(windows.last))
    low_a, high_a = windows.bounds(first)
    low_b, high_b = windows.bounds(last)
    asked = spark.range(blocks).withColumnRenamed("id", "q").select(
        "q",
        F.floor((low_a - 1) / size).alias("block_a"),
        F.floor((high_b - 1) / size).alias("block_b"),
        F.ceil((low_b - 1) / size).alias("core_a"),
        (F.floor(high_a / size) - 1).alias("core_b"),
        # 0-based middle of the windows, and their sizes, at both ends of the block
        F.floor((high_a - low_a) / 2).alias("mid_a"),
        F.floor((high_b - low_b) / 2).alias("mid_b"),
        (high_a - low_a + 1).alias("size_a"),
        (high_b - low_b + 1).alias("size_b"),
    )
    longest = max(high - low + 1 for low, high in (windows.bounds(windows.first), windows.bounds(windows.last)))
    with_cores = longest >= 4 * size  # shorter windows are a few blocks, which are simply read
    has_core = F.lit(with_cores) & (F.col("core_b") - F.col("core_a") >= 1)

    whole = F.sequence("block_a", "block_b")
    around = F.filter(whole, lambda b: (b < F.col("core_a")) | (b > F.col("core_b")))
    fringe_blocks = asked.select("q", F.explode(F.when(has_core, around).otherwise(whole)).alias("_block"))
    payload = pieces.join(fringe_blocks, "_block").select("q", F.lit(0).alias("kind"), "rn", "n_rows", "r")
    if with_cores:
        payload = payload.unionByName(_core_band(pieces, asked.filter(has_core), size))
    return payload


def _core_band(pieces: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """Per asked block: the distinct core values near the middle rank (kind 1), the count of those below (kind 2)."""
    edges = bucket_edges(pieces.select("r"), "r", block_rows=4 * size)
    placed = with_bucket(pieces, "r", edges, "_bucket")
    # core counts per value bucket: cumulative counts along the blocks, read off at both ends of each core
    cells = placed.groupBy("_bucket", "_block").agg(F.sum("n_rows").alias("_c"))
    ends = F.array(
        F.struct(F.lit(-1).alias("_sign"), (F.col("core_a") - 1).alias("_block")),
        F.struct(F.lit(1).alias("_sign"), F.col("core_b").alias("_block")),
    )
    marks = asked.select("q", F.inline(ends)).withColumn(
        "_bucket", F.explode(F.sequence(F.lit(0), F.lit(len(edges))))
    )
    upto_block = Window.partitionBy("_bucket").orderBy("_block").rangeBetween(Window.unboundedPreceding, 0)
    inside = (
        cells.unionByName(marks, allowMissingColumns=True)
        .withColumn("_upto", F.coalesce(F.sum("_c").over(upto_block), F.lit(0)))
        .filter(F.col("q").isNotNull())
        .groupBy("q", "_bucket")
        .agg(F.sum(F.col("_sign") * F.col("_upto")).alias("_in"))
        .filter("_in > 0")
    )
    along = Window.partitionBy("q").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    core_rows = (F.col("core_b") - F.col("core_a") + 1) * size
    ranked = (
        inside.withColumn("_to", F.sum("_in").over(along))
        .join(asked, "q")
        .withColumn(
            "_rank_a",
            F.least(
                F.col("mid_a") - (F.col("size_a") - core_rows), F.col("mid_b") - (F.col("size_b") - core_rows)
            ),
        )
        .withColumn("_rank_b", F.greatest("mid_a", "mid_b"))
    )
    below = F.col("_to") - 1 < F.col("_rank_a")
    skipped = ranked.filter(below).groupBy("q").agg(F.sum("_in").alias("n_rows"))
    band = ranked.filter(~below & (F.col("_to") - F.col("_in") <= F.col("_rank_b")))
    wanted = band.select("q", "_bucket", F.explode(F.sequence("core_a", "core_b")).alias("_block"))
    per_block = placed.groupBy("_block", "_bucket", "r").agg(F.sum("n_rows").alias("n_rows"))
    kept = per_block.join(wanted, ["_block", "_bucket"]).groupBy("q", "r").agg(F.sum("n_rows").alias("n_rows"))
    nowhere = F.lit(None).cast("long")
    return kept.select("q", F.lit(1).alias("kind"), nowhere.alias("rn"), "n_rows", "r").unionByName(
        skipped.select("q", F.lit(2).alias("kind"), nowhere.alias("rn"), "n_rows", F.lit(None).cast("double").alias("r"))
    )


def _middle(a: float, b: float, c: float) -> float:
    return sorted((a, b, c))[1]


def rolling_median(runs: DataFrame, n: int, denom: float = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running median of a sequence of ``n`` positions with a window of n / denom, as runs.

    Towards the ends the window shrinks over the already smoothed sequence, and the two end points follow
    Tukey's rule. A NULL or NaN in the sequence is an error: it has no rank.
    """
    require_columns(runs, ["rn", "n_rows", "r"])
    half = (median_window(n, denom) - 1) // 2
    missing = F.raise_error(F.lit("a value of the sequence is missing"))
    runs = runs.select("rn", "n_rows", F.when(F.col("r").isNull() | F.isnan("r"), missing).otherwise(F.col("r")).alias("r"))
    if half == 0:
        return runs
    # blocks grow with the root of n, so that the table of (block, value bucket) counts stays smaller than the data
    block_rows = block_size(n, block_rows)

    def trim(df):
        return df.select("rn", "n_rows", "r")

    inner = range_medians(runs, Windows(half + 1, n - half, (1, -half), (1, half)), block_rows)
    raw_ends = _clip(runs, 1, half).unionByName(_clip(runs, n - half + 1, n))
    mixed = materialise(trim(inner).unionByName(raw_ends))
    smoothed = _clip(mixed, half + 1, n - half)
    if half >= 2:
        left = range_medians(_clip(mixed, 1, 2 * half - 1), Windows(2, half, (0, 1), (2, -1)), block_rows)
        right = range_medians(
            _clip(mixed, n - 2 * half + 2, n), Windows(n + 1 - half, n - 1, (2, -n), (0, n)), block_rows
        )
        smoothed = smoothed.unionByName(materialise(left.unionByName(right)))
    return smoothed.unionByName(_end_points(mixed, smoothed, n))


def _end_points(mixed: DataFrame, smoothed: DataFrame, n: int) -> DataFrame:
    """Positions 1 and n: the middle of the unsmoothed end, its neighbour, and the line through its neighbours."""

    def value(i):
        covers = F.lit(i).between(F.col("rn"), F.col("rn") + F.col("n_rows") - 1)
        return F.max(F.when(covers, F.col("r")))

    a1, b1 = mixed.agg(value(1), value(n)).first()
    a2, a3, b2, b3 = smoothed.agg(value(2), value(3), value(n - 1), value(n - 2)).first()
    first = _middle(a1, a2, 3 * a2 - 2 * (b1 if n == 3 else a3))
    last = _middle(b1, b2, 3 * b2 - 2 * (first if n == 3 else b3))
    return mixed.sparkSession.range(2).select(
        F.when(F.col("id") == 0, 1).otherwise(n).cast("long").alias("rn"),
        F.lit(1).cast("long").alias("n_rows"),
        F.when(F.col("id") == 0, first).otherwise(last).alias("r"),
    )
