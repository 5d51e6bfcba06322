"""Cross-validation folds, bags, exact-size down-sampling and hyper-parameter grids.

Every random choice orders rows by an md5 of (seed, key), so the draw depends on neither partitioning nor
engine. Ranks along that order are taken per hash prefix and carried, never over a whole class at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns
from puspark.operators.joins import BROADCAST_ROWS, HOT_ROWS, skewed_join, small_side
from puspark.operators.scan import Scan, two_level_scan
from puspark.sources.shared import materialise

PREFIX_DIGITS = 4


def draw(seed: Column | str, key: Column | str) -> Column:
    """The text rows are drawn by."""
    return F.md5(F.concat_ws("|", seed, key))


def assign_folds(
    df: DataFrame,
    k: int,
    seeds: Sequence[int],
    key: str = "ind_id",
    strata: str | None = None,
    group: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Table (common_seed, fold_id, key): k disjoint assessment sets per seed.

    ``strata`` spreads each value evenly over the folds; ``group`` keeps all rows of a value together. A key
    has one row per seed in the result, however many rows it has in ``df``. Groups of more than ``hot_rows`` rows
    are given their fold by broadcast.
    """
    if strata and group:
        raise ValueError("choose either strata or group")
    require_columns(df, [c for c in (key, strata, group) if c])
    side = [c for c in (strata, group) if c]
    if side:  # one value per entity
        differs = F.raise_error(F.concat(F.lit(f"differing values of {side[0]} for {key} "), F.col(key).cast("string")))
        agreed = F.min(side[0]).eqNullSafe(F.max(side[0])) & ((F.count(side[0]) == 0) | (F.count(side[0]) == F.count(F.lit(1))))
        entities = df.groupBy(key).agg(F.max(side[0]).alias(side[0]), agreed.alias("_one"))
        entities = entities.select(key, F.when(F.col("_one"), F.col(side[0])).otherwise(differs).alias(side[0]))
    else:
        entities = df.select(key).distinct()
    if group:  # rows without a group form one
        entities = entities.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("")))
    unit = "_group" if group else key
    units = entities.groupBy(unit).agg(F.count(F.lit(1)).alias("_size")) if group else entities
    seeded = units.withColumn("common_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    drawn = seeded.withColumn("_draw", draw("common_seed", unit)).withColumn(
        "_block", F.substring("_draw", 1, PREFIX_DIGITS)
    )
    keys = ["common_seed", *([strata] if strata else [])]
    ranked = two_level_scan(drawn, [Scan("_before", F.lit(1), "sum", -1)], ["_draw", unit], "_block", keys)
    fold = F.concat(F.lit("Fold"), F.pmod("_before", F.lit(k)) + 1).alias("fold_id")
    if not group:
        return ranked.select("common_seed", fold, key)
    folds = materialise(ranked.select("common_seed", fold, unit, "_size"))
    return skewed_join(entities, folds, unit, "_size", hot_rows).select("common_seed", "fold_id", key)


def folds_for(folds: DataFrame, common_seed: int) -> DataFrame:
    return folds.filter(F.col("common_seed") == common_seed)


def with_folds(df: DataFrame, folds: DataFrame, key: str = "ind_id") -> DataFrame:
    """Every row of ``df`` once per seed, with the fold it is assessed in."""
    return df.join(folds, key)


def require_partition(df: DataFrame, folds: DataFrame, key: str = "ind_id") -> None:
    """Every entity of ``df`` is in exactly one fold per seed: otherwise a model could be assessed on its training rows,
    or rows would be left out of training and scores. Counts combine before their shuffle."""
    repeated = folds.groupBy("common_seed", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        row = repeated[0]
        raise ValueError(f"{key} {row[key]!r} is in {row['n']} folds of seed {row['common_seed']}; one is expected")
    seeds = folds.agg(F.count_distinct("common_seed")).first()[0]
    placed = folds.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    lost = df.select(key).distinct().join(placed, key, "left").filter(F.coalesce("_n", F.lit(0)) < seeds).limit(1).collect()
    if lost:
        raise ValueError(f"{key} {lost[0][key]!r} has no fold in {seeds - (lost[0]['_n'] or 0)} of {seeds} seeds")


def split(df: DataFrame, folds: DataFrame, common_seed: int, fold_id: str, key: str = "ind_id"):
    """(analysis, assessment) rows of one fold of one seed."""
    placed = with_folds(df, folds_for(folds, common_seed), key)
    inside = F.col("fold_id") == fold_id
    drop = ["common_seed", "fold_id"]
    return placed.filter(~inside).drop(*drop), placed.filter(inside).drop(*drop)


def make_bags(spark: SparkSession, seeds: Sequence[int], bags_per_seed: int) -> DataFrame:
    """Table (common_seed, bag, recipe_seed, counter), one row per bag."""
    numbered = spark.range(len(seeds) * bags_per_seed)
    which = F.floor(F.col("id") / bags_per_seed).cast("int")
    seed = F.element_at(F.array(*[F.lit(int(s)) for s in seeds]), which + 1)
    bag = (F.col("id") % bags_per_seed + 1).cast("int")
    return numbered.select(
        seed.alias("common_seed"),
        bag.alias("bag"),
        (seed * 1000 + bag).cast("int").alias("recipe_seed"),
        (F.col("id") + 1).cast("int").alias("counter"),
    )


def _cutoffs(hist: DataFrame, groups: Sequence[str], label: str, ratio: float) -> DataFrame:
    """Per group and class: the size to keep, the prefix the last kept row is in, and how many of that prefix.

    ``hist`` counts rows by (groups, label, prefix). Classes sized by a NULL label are capped but do not set
    the size of the smallest class.
    """
    # placed by group once, so that all windows and the final grouping share that shuffle; a group has at most
    # 16 ** PREFIX_DIGITS rows per class
    placed = hist.repartition(*groups) if groups else hist
    within = Window.partitionBy(*groups, label)
    sized = placed.withColumns(
        {
            "_class": F.sum("n").over(within),
            "_upto": F.sum("n").over(within.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    smallest = F.min(F.when(F.col(label).isNotNull(), F.col("_class"))).over(Window.partitionBy(*groups))
    return (
        sized.withColumn("_cap", F.floor(smallest * F.lit(float(ratio))))
        .groupBy(*groups, label)
        .agg(
            F.min(F.when(F.col("_upto") >= F.col("_cap"), F.col("_prefix"))).alias("_edge"),
            F.max(F.when(F.col("_upto") < F.col("_cap"), F.col("_upto"))).alias("_sure"),
            F.max("_cap").alias("_cap"),
        )
        .select(*groups, label, "_edge", (F.col("_cap") - F.coalesce("_sure", F.lit(0))).alias("_left"))
    )


def _last_kept(rows: DataFrame, groups: Sequence[str], label: str, key: str) -> DataFrame:
    """Per group and class the last row that is kept of the edge prefix: ``_left`` rows of it are, in order of the draw."""
    place = F.row_number().over(Window.partitionBy(*groups, label).orderBy("_draw", key))
    edge = rows.filter(F.col("_prefix") == F.col("_edge")).withColumn("_place", place)
    last = F.struct(F.col("_draw").alias("draw"), F.col(key).alias("key"))
    return edge.filter(F.col("_place") == F.col("_left")).select(*groups, label, last.alias("_last"))


def _is_kept(key: str) -> Column:
    """A class smaller than its cap is kept whole; of others what comes no later than the last kept row."""
    here = F.struct(F.col("_draw").alias("draw"), F.col(key).alias("key"))
    upto = (F.col("_prefix") == F.col("_edge")) & F.coalesce(here <= F.col("_last"), F.lit(False))
    return F.col("_edge").isNull() | (F.col("_prefix") < F.col("_edge")) | upto


def _broadcast_joined(rows: DataFrame, cut: DataFrame, matched: Column) -> DataFrame:
    """``rows`` joined with the cut-offs by broadcast: as few rows as models and classes, and more in several passes."""
    parts = max(1, -(-cut.count() // BROADCAST_ROWS))
    slot = F.pmod(F.xxhash64(*cut.columns), F.lit(parts))
    pieces = [rows.join(F.broadcast(cut.filter(slot == i) if parts > 1 else cut), matched) for i in range(parts)]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def downsample(df: DataFrame, label: str, ratio: float, seed: int, key: str = "ind_id") -> DataFrame:
    """At most ``floor(ratio * size of the smallest class)`` rows of each class, drawn by ``seed``.

    Narrow passes count rows by (class, hash prefix) and rank those of the one prefix that the cap falls in; the rows
    themselves are read once, and kept by comparing their draw with the last one kept.
    """
    drawn = draw(F.lit(seed), key)
    rows = df.withColumn("_draw", drawn).withColumn("_prefix", F.substring("_draw", 1, PREFIX_DIGITS))
    hist = rows.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("n"))
    cut = materialise(_cutoffs(hist, [], label, ratio)).withColumnRenamed(label, "_label")
    same = F.col(label).eqNullSafe(F.col("_label"))
    narrow = _broadcast_joined(rows.select(label, key, "_draw", "_prefix"), cut, same).drop("_label")
    last = _last_kept(narrow, [], label, key).withColumnRenamed(label, "_l")
    cut = materialise(cut.join(last, F.col("_label").eqNullSafe(F.col("_l")), "left").drop("_l"))
    kept = _broadcast_joined(rows, cut, same).filter(_is_kept(key))
    return kept.drop("_label", "_draw", "_prefix", "_edge", "_left", "_last")


def downsample_bags(
    folded: DataFrame, bags: DataFrame, label: str, ratio: float, key: str = "ind_id"
) -> DataFrame:
    """The training sample of every (common_seed, bag, fold): analysis rows of the fold, down-sampled by the bag's seed.

    ``folded`` holds each row once per seed with its fold. Counts are taken per *assessment* fold and an analysis
    set's counts are the seed's total less its own fold's, so no row is repeated per fold before it is selected.
    """
    model = ["common_seed", "bag", "fold_id"]
    seeds = bags.select("common_seed", "bag", "recipe_seed", "counter")
    drawn = (
        folded.join(small_side(seeds), "common_seed")
        .withColumn("_draw", draw("recipe_seed", key))
        .withColumn("_prefix", F.substring("_draw", 1, PREFIX_DIGITS))
    )
    own = drawn.groupBy(*model, label, "_prefix").agg(F.count(F.lit(1)).alias("n"))
    per_seed = own.groupBy("common_seed", "bag", label, "_prefix").agg(
        F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("fold_id", "n"))).alias("_own")
    )
    fold_names = folded.groupBy("common_seed").agg(F.collect_set("fold_id").alias("_folds"))
    hist = (
        per_seed.join(fold_names, "common_seed")
        .withColumn("fold_id", F.explode("_folds"))
        .select(
            *model,
            label,
            "_prefix",
            (F.col("_all") - F.coalesce(F.try_element_at("_own", F.col("fold_id")), F.lit(0))).alias("n"),
        )
        .filter("n > 0")
    )
    return _kept_rows(drawn, hist, F.col("fold_id") != F.col("_fold"), label, ratio, key)


def downsample_sets(analysis: DataFrame, bags: DataFrame, label: str, ratio: float, key: str = "ind_id") -> DataFrame:
    """The training sample of every (common_seed, bag, fold_id) from rows that say which sets they are in.

    ``analysis`` holds a row once per (common_seed, fold_id) it trains, with ``times``: how often; sets may overlap. Each
    time is a row of its own, drawn by itself. Counts are taken per set; only narrow columns are repeated for them.
    """
    model = ["common_seed", "bag", "fold_id"]
    seeds = bags.select("common_seed", "bag", "recipe_seed", "counter")
    own = F.when(F.col("_copy") == 1, F.col(key).cast("string")).otherwise(F.concat_ws("|", key, "_copy"))
    drawn = (
        analysis.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times")))
        .join(small_side(seeds), "common_seed")
        .withColumn("_draw", draw("recipe_seed", own))
        .withColumn("_prefix", F.substring("_draw", 1, PREFIX_DIGITS))
        .drop("times", "_copy")
    )
    hist = drawn.groupBy(*model, label, "_prefix").agg(F.count(F.lit(1)).alias("n"))
    return _kept_rows(drawn, hist, F.col("fold_id") == F.col("_fold"), label, ratio, key)


def _kept_rows(drawn: DataFrame, hist: DataFrame, of_set: Column, label: str, ratio: float, key: str) -> DataFrame:
    """Rows of every model's sample; ``of_set`` tells whether a row's ``fold_id`` is in the set of split ``_fold``."""
    renamed = {"common_seed": "_seed", "bag": "_bag", "fold_id": "_fold", label: "_label"}
    cut = materialise(_cutoffs(hist, ["common_seed", "bag", "fold_id"], label, ratio).withColumnsRenamed(renamed))
    matched = (
        (F.col("common_seed") == F.col("_seed"))
        & (F.col("bag") == F.col("_bag"))
        & F.col(label).eqNullSafe(F.col("_label"))
        & of_set
        & (F.col("_edge").isNull() | (F.col("_prefix") <= F.col("_edge")))
    )
    narrow = drawn.select("common_seed", "bag", "fold_id", label, key, "_draw", "_prefix")
    names = list(renamed.values())
    last = _last_kept(_broadcast_joined(narrow, cut, matched & (F.col("_prefix") == F.col("_edge"))), names[:3], "_label", key)
    last = last.withColumnsRenamed({c: f"{c}2" for c in names})
    same = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in names]
    cut = materialise(cut.join(last, same, "left").drop(*[f"{c}2" for c in names]))
    rows = _broadcast_joined(drawn, cut, matched).filter(_is_kept(key)).withColumn("fold_id", F.col("_fold"))
    return rows.drop(*names, "_draw", "_prefix", "_edge", "_left", "_last")


def latin_hypercube(
    spark: SparkSession, ranges: Mapping[str, tuple[float, float]], n: int, seeds: Sequence[int]
) -> DataFrame:
    """``n`` space-filling configs per seed: (common_seed, config, one column per parameter).

    Each parameter's range is cut into n equal strata and every stratum's mid-point is used once. Integer bounds
    give integer values, both ends as likely as the others: the strata then divide the whole numbers of the range. Where
    these are fewer than n, configs may agree in all parameters; one of them is kept, so there may be fewer than n.
    """
    grid = spark.range(1, n + 1).select(
        F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("common_seed"), F.col("id").cast("int").alias("config")
    )
    for name, (low, high) in ranges.items():
        order = Window.partitionBy("common_seed").orderBy(
            F.md5(F.concat_ws("|", "common_seed", F.lit(name), "config")), "config"
        )
        part = (F.row_number().over(order) - 0.5) / n
        whole = isinstance(low, int) and isinstance(high, int)
        grid = grid.withColumn(name, (low + F.floor(part * (high - low + 1))).cast("int") if whole else low + part * F.lit(float(high - low)))
    return grid.groupBy("common_seed", *ranges).agg(F.min("config").alias("config")).select("common_seed", "config", *ranges)


def data_ranges(df: DataFrame, label: str, features: Sequence[str], share: float = 0.1) -> dict[str, tuple[int, int]]:
    """Ranges of parameters whose bounds depend on the data, for ``latin_hypercube``: features per split, up to all of
    them, and rows per leaf, from 2 up to ``share`` of the smallest class."""
    require_columns(df, [label, *features])
    smallest = df.filter(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return {"features_per_split": (1, len(features)), "min_instances_per_node": (2, max(2, int(smallest * share)))}


def explicit_grid(bags: DataFrame, grid: DataFrame) -> DataFrame:
    """A caller's table of configs, repeated for every seed of ``bags``."""
    if "common_seed" in grid.columns:
        return grid
    seeds = bags.groupBy().agg(F.sort_array(F.collect_set("common_seed")).alias("s")).first()["s"]
    return grid.withColumn("common_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
