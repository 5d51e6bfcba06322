"""Folds of whole groups with even numbers of rows and of every stratum, and strata of a number."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns
from puspark.operators.joins import HOT_ROWS, skewed_join
from puspark.operators.sampling import PREFIX_DIGITS, draw
from puspark.operators.scan import BLOCK_ROWS, Scan, bucket_edges, two_level_scan, with_bucket
from puspark.sources.shared import materialise

#: Groups with more than this part of a fold's rows are packed one by one: there are at most so many of them per fold.
HEAVY_PER_FOLD = 500


def pack(groups: Sequence[tuple[object, Sequence[int]]], totals: Sequence[int], k: int) -> tuple[dict, list[list[int]]]:
    """Fold number from 1 of every (name, rows per stratum), in the given order, and the folds' rows per stratum.

    A group goes to the fold that holds the least of the strata the group is made of, each weighed by its total; of
    equal ones to that of the fewest rows, then to the first.
    """
    loads = [[0] * len(totals) for _ in range(k)]
    square = [max(t, 1) ** 2 for t in totals]
    whole = 1
    for s in square:
        whole *= s
    weights = [whole // s for s in square]
    placed = {}
    for name, rows in groups:
        # whole numbers: the same fold on any machine
        held = [(sum(w * a * b for w, a, b in zip(weights, load, rows)), sum(load), f) for f, load in enumerate(loads)]
        fold = min(held)[2]
        loads[fold] = [a + b for a, b in zip(loads[fold], rows)]
        placed[name] = fold + 1
    return placed, loads


def balanced_group_folds(
    df: DataFrame,
    k: int,
    seeds: Sequence[int],
    group: str,
    strata: str | None = None,
    key: str = "ind_id",
    heavy_per_fold: int = HEAVY_PER_FOLD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Table (common_seed, fold_id, key): k disjoint assessment sets per seed that keep groups whole, of about the same
    number of rows and of rows of every stratum.

    Large groups first: those with more than a ``heavy_per_fold``-th of a fold's rows are packed one by one, by size
    (in powers of two) and then by the seed's draw. They are a bounded number, whatever the table. All others are lined up
    by the draw, those of one main stratum after another, and each fold takes a stretch of the line as long as it is
    short of rows. Rows without a group form one, rows without a stratum have one of their own; strata are few values.
    """
    require_columns(df, [c for c in (key, group, strata) if c])
    side = [F.count_distinct(c).alias(f"_n{i}") for i, c in enumerate(c for c in (group, strata) if c)]
    differing = df.groupBy(key).agg(*side).filter(" or ".join(f"_n{i} > 1" for i in range(len(side)))).limit(1).collect()
    if differing:
        raise ValueError(f"differing values of {group}{' or ' + strata if strata else ''} for {key} {differing[0][key]!r}")
    stratum = (F.coalesce(F.max(strata).cast("string"), F.lit("")) if strata else F.lit("")).alias("_stratum")
    entities = materialise(df.groupBy(key).agg(F.coalesce(F.max(group).cast("string"), F.lit("")).alias("_group"), stratum))
    counts = {r["_stratum"]: r["count"] for r in entities.groupBy("_stratum").count().collect()}
    names = sorted(counts)
    totals = [counts[s] for s in names]
    rows = [F.count_if(F.col("_stratum") == s).alias(f"_s{i}") for i, s in enumerate(names)]
    units = materialise(entities.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"), *rows))
    least = sum(totals) / (k * heavy_per_fold)
    heavy = units.filter(F.col("_size") > least).collect()  # at most k * heavy_per_fold rows
    light = units.filter(F.col("_size") <= least)
    tables = []
    for seed in seeds:
        drawn = sorted(heavy, key=lambda r: (-r["_size"].bit_length(), _md5(seed, r["_group"])))
        placed, loads = pack([(r["_group"], [r[f"_s{i}"] for i in range(len(names))]) for r in drawn], totals, k)
        short = [max(0, sum(totals) / k - sum(load)) for load in loads]
        tables.append(_stretches(light, seed, short, len(names), totals))
        if placed:
            made = [(seed, name, fold) for name, fold in placed.items()]
            tables.append(df.sparkSession.createDataFrame(made, "common_seed int, _group string, _fold int"))
    folds = tables[0]
    for table in tables[1:]:
        folds = folds.unionByName(table)
    folds = materialise(folds.join(units.select("_group", "_size"), "_group"))
    result = skewed_join(entities.select(key, "_group"), folds, "_group", "_size", hot_rows)
    return result.select("common_seed", F.concat(F.lit("Fold"), "_fold").alias("fold_id"), key)


def _md5(seed: int, text: str) -> str:
    return hashlib.md5(f"{seed}|{text}".encode()).hexdigest()


def _stretches(light: DataFrame, seed: int, short: Sequence[float], n: int, totals: Sequence[int]) -> DataFrame:
    """(common_seed, _group, _fold): groups in the order of the draw, in stretches as long as the folds are short."""
    shares = [F.struct((F.col(f"_s{i}") / F.lit(float(max(totals[i], 1)))).alias("share"), F.lit(i).alias("kind")) for i in range(n)]
    kind = F.array_max(F.array(*shares))["kind"] if n else F.lit(0)
    drawn = light.select("_group", "_size", kind.alias("_kind"), draw(F.lit(seed), "_group").alias("_draw"))
    drawn = drawn.withColumn("_block", F.substring("_draw", 1, PREFIX_DIGITS))
    lined = two_level_scan(drawn, [Scan("_before", F.col("_size"), "sum", -1)], ["_draw", "_group"], "_block", ["_kind"])
    whole = light.sparkSession.createDataFrame([(i,) for i in range(n)], "_kind int")
    length = drawn.groupBy("_kind").agg(F.sum("_size").alias("_length"))
    lined = lined.join(F.broadcast(whole.join(length, "_kind")), "_kind")  # one row per stratum
    total = sum(short) or float(len(short))
    short = short if sum(short) else [1.0] * len(short)
    middle = (F.col("_before") + F.col("_size") / 2) / F.col("_length")
    fold: Column = F.lit(len(short))
    for f in range(len(short) - 1, 0, -1):
        fold = F.when(middle < F.lit(sum(short[:f]) / total), F.lit(f)).otherwise(fold)
    return lined.select(F.lit(seed).cast("int").alias("common_seed"), "_group", fold.cast("int").alias("_fold"))


def pooled_edges(edges: Sequence[float], counts: Sequence[int], least: float) -> list[float]:
    """Lower ends of bins after every bin of fewer than ``least`` rows has joined its smaller neighbour, the smallest one
    first and of equal ones the first; of equal neighbours it joins the one below."""
    bins = list(zip(edges, counts))
    while len(bins) > 1 and min(n for _, n in bins) < least:
        at = min(range(len(bins)), key=lambda i: bins[i][1])
        above = at == 0 or (at + 1 < len(bins) and bins[at + 1][1] < bins[at - 1][1])
        low = at if above else at - 1
        bins[low : low + 2] = [(bins[low][0], bins[low][1] + bins[low + 1][1])]
    return [e for e, _ in bins]


def numeric_strata(df: DataFrame, column: str, bins: int = 4, pool: float = 0.1, name: str = "stratum", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``name``: the bin, from 0, of ``bins`` equal shares of ``column``; null where the number is null or NaN.

    A value's bin follows from the number of rows below it, so equal values are in one. Bins with less than ``pool`` of
    the rows join their smaller neighbour. Counts run over distinct values in blocks; what comes to the driver is one
    number per bin, and rows are placed by comparison with these, without a join.
    """
    value = F.col(column).cast("double")
    known = df.select(F.when(~F.isnan(value), value + F.lit(0.0)).alias("v")).filter("v is not null")
    values = materialise(known.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    total = values.agg(F.sum("n")).first()[0] or 0
    if not total:
        return df.withColumn(name, F.lit(None).cast("int"))
    blocked = with_bucket(values, "v", bucket_edges(values, "v", block_rows=block_rows), "_block")
    below = two_level_scan(blocked, [Scan("_below", F.col("n"), "sum", -1)], ["v"], "_block")
    binned = below.groupBy(F.floor(F.col("_below") * bins / F.lit(total)).alias("bin")).agg(F.min("v").alias("low"), F.sum("n").alias("n"))
    found = sorted((r["low"], r["n"]) for r in binned.collect())  # one row per bin
    lows = pooled_edges([low for low, _ in found], [n for _, n in found], pool * total)
    place = F.lit(0)
    for low in lows[1:]:
        place = place + (value >= F.lit(low)).cast("int")
    return df.withColumn(name, F.when(~F.isnan(value), place))
