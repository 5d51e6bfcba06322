"""Splits that need not be partitions: repeated folds, Monte-Carlo splits and bootstrap samples.

A split table says which rows are in which part of which split: (common_seed, fold_id, key, part, times). ``part`` is
``analysis`` or ``assessment``; ``times`` is how often the row is in it, more than once in bootstrap samples only.
Everything that takes a table of folds for training takes a split table too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns
from puspark.operators.joins import small_side
from puspark.operators.sampling import PREFIX_DIGITS, assign_folds, downsample_sets, draw
from puspark.operators.scan import Scan, two_level_scan
from puspark.sources.shared import materialise

ANALYSIS, ASSESSMENT = "analysis", "assessment"
SPLIT = ("common_seed", "fold_id")
#: Repeats and splits are numbered within a seed: ``seed * 1000 + number`` draws them.
PER_SEED = 1000


def is_split_table(folds: DataFrame) -> bool:
    return "part" in folds.columns


def _numbered(n: int, what: str) -> range:
    if not 1 <= n < PER_SEED:
        raise ValueError(f"between 1 and {PER_SEED - 1} {what} are possible, not {n}")
    return range(1, n + 1)


def repeated_folds(df: DataFrame, k: int, repeats: int, seeds: Sequence[int], key: str = "ind_id", strata: str | None = None) -> DataFrame:
    """``repeats`` independent divisions into ``k`` folds per seed; splits are named ``Repeat1.Fold2``.

    A row is in the assessment set of one split of each repeat and in the analysis sets of the others.
    """
    drawn = [seed * PER_SEED + i for seed in seeds for i in _numbered(repeats, "repeats")]
    own = assign_folds(df, k, drawn, key, strata)
    number = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_split")
    placed = own.select(F.col("common_seed").alias("_drawn"), F.substring("fold_id", len("Fold") + 1, 10).cast("int").alias("_own"), key, number)
    name = F.concat(F.lit("Repeat"), F.pmod("_drawn", F.lit(PER_SEED)), F.lit(".Fold"), F.col("_split"))
    return placed.select(
        F.floor(F.col("_drawn") / PER_SEED).cast("int").alias("common_seed"),
        name.alias("fold_id"),
        key,
        F.when(F.col("_split") == F.col("_own"), ASSESSMENT).otherwise(ANALYSIS).alias("part"),
        F.lit(1).alias("times"),
    )


def _entities(df: DataFrame, key: str, strata: str | None) -> DataFrame:
    """One row per key with ``_class``, its stratum; a key with two of them is an error."""
    require_columns(df, [c for c in (key, strata) if c])
    if not strata:
        return df.select(key).distinct().withColumn("_class", F.lit(0))
    differs = F.raise_error(F.concat(F.lit(f"differing values of {strata} for {key} "), F.col(key).cast("string")))
    agreed = F.min(strata).eqNullSafe(F.max(strata)) & ((F.count(strata) == 0) | (F.count(strata) == F.count(F.lit(1))))
    rows = df.groupBy(key).agg(F.max(strata).alias("_value"), agreed.alias("_one"))
    return rows.select(key, F.when(F.col("_one"), F.col("_value")).otherwise(differs).alias("_class"))


def _ranked(df: DataFrame, key: str, strata: str | None, drawn: Sequence[int]) -> DataFrame:
    """(_drawn, _class, key, _before, _n): every entity's place from 0 in the draw of its class, and the class's size.

    Places run over prefixes of the draw: no class is ever ordered in one task.
    """
    rows = materialise(_entities(df, key, strata))
    sizes = small_side(rows.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")))
    same = rows["_class"].eqNullSafe(sizes["_class"])
    rows = rows.join(sizes, same).drop(sizes["_class"])
    rows = rows.withColumn("_drawn", F.explode(F.array(*[F.lit(d) for d in drawn]))).withColumn("_draw", draw("_drawn", key))
    rows = rows.withColumn("_block", F.substring("_draw", 1, PREFIX_DIGITS))
    return two_level_scan(rows, [Scan("_before", F.lit(1), "sum", -1)], ["_draw", key], "_block", ["_drawn", "_class"])


def _named(rows: DataFrame, word: str, key: str) -> DataFrame:
    return rows.select(
        F.floor(F.col("_drawn") / PER_SEED).cast("int").alias("common_seed"),
        F.concat(F.lit(word), F.pmod("_drawn", F.lit(PER_SEED))).alias("fold_id"),
        key,
        "part",
        F.col("times").cast("int").alias("times"),
    )


def monte_carlo_splits(
    df: DataFrame, share: float, n: int, seeds: Sequence[int], key: str = "ind_id", strata: str | None = None
) -> DataFrame:
    """``n`` independent splits per seed, named ``Split1``: the first ``floor(share * size)`` rows of every stratum's draw
    are for analysis, the others for assessment."""
    if not 0 < share < 1:
        raise ValueError("the share for analysis is between 0 and 1")
    drawn = [seed * PER_SEED + i for seed in seeds for i in _numbered(n, "splits")]
    inside = F.col("_before") < F.floor(F.col("_n") * F.lit(float(share)))
    rows = _ranked(df, key, strata, drawn).withColumn("part", F.when(inside, ANALYSIS).otherwise(ASSESSMENT))
    return _named(rows.withColumn("times", F.lit(1)), "Split", key)


def uniform_index(text: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that a text draws: 60 bits of its MD5, so that the remainder's bias is below n / 2^60."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n


def bootstrap_splits(df: DataFrame, n: int, seeds: Sequence[int], key: str = "ind_id", strata: str | None = None) -> DataFrame:
    """``n`` bootstrap samples per seed, named ``Bootstrap1``: analysis sets hold as many rows as there are, drawn with
    replacement (within strata), and assessment sets the rows that are not drawn.

    Draws are numbered; each picks a place in the class's own order by its hash, and picks of a place are counted before
    they are shuffled to the row there. No task sees more than its share of draws, however large a class is.
    """
    drawn = [seed * PER_SEED + i for seed in seeds for i in _numbered(n, "samples")]
    ranked = materialise(_ranked(df, key, strata, drawn))
    # every row stands for one numbered draw of its class and split
    text = F.concat_ws("|", F.lit("pick"), F.col("_drawn"), F.coalesce(F.col("_class").cast("string"), F.lit("")), F.col("_before"))
    picks = ranked.select("_drawn", F.col("_class").alias("_of"), uniform_index(text, F.col("_n")).alias("_place"))
    picks = picks.groupBy("_drawn", "_of", "_place").agg(F.count(F.lit(1)).alias("times")).withColumnRenamed("_drawn", "_in")
    met = (F.col("_drawn") == F.col("_in")) & F.col("_class").eqNullSafe(F.col("_of")) & (F.col("_before") == F.col("_place"))
    rows = ranked.join(picks, met, "left")
    part = F.when(F.col("times").isNull(), ASSESSMENT).otherwise(ANALYSIS)
    return _named(rows.withColumn("part", part).withColumn("times", F.coalesce("times", F.lit(1))), "Bootstrap", key)


def require_disjoint(df: DataFrame, splits: DataFrame, key: str = "ind_id") -> None:
    """No row is in both parts of a split, or twice in the table; every row of ``df`` is in the table, every split has
    both parts. Counts combine before their shuffle."""
    require_columns(splits, [*SPLIT, key, "part", "times"])
    wrong = splits.filter(~F.col("part").isin(ANALYSIS, ASSESSMENT) | (F.col("times") < 1) | F.col("part").isNull() | F.col("times").isNull())
    if not wrong.isEmpty():
        raise ValueError(f"parts are {ANALYSIS} and {ASSESSMENT}, times at least 1")
    both = splits.groupBy(*SPLIT, key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if both:
        row = both[0]
        raise ValueError(f"{key} {row[key]!r} is {row['n']} times in split {row['fold_id']} of seed {row['common_seed']}")
    lost = df.select(key).distinct().join(splits.select(key).distinct(), key, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{key} {lost[0][key]!r} is in no split")
    parts = splits.groupBy(*SPLIT).agg(F.count_distinct("part").alias("n")).filter("n < 2").limit(1).collect()
    if parts:
        raise ValueError(f"split {parts[0]['fold_id']} of seed {parts[0]['common_seed']} has one part only")


def packed(splits: DataFrame, key: str = "ind_id") -> DataFrame:
    """One row per key with the splits it is in: ``analysis`` and ``assessment``, arrays of (common_seed, fold_id, times).

    As long as there are splits; rows are then joined with it once, whatever the number of splits.
    """
    place = F.struct(*SPLIT, "times")
    lists = [F.collect_list(F.when(F.col("part") == p, place)).alias(f"_{p}") for p in (ANALYSIS, ASSESSMENT)]
    return splits.groupBy(key).agg(*lists)


def members(df: DataFrame, splits: DataFrame, part: str, key: str = "ind_id") -> DataFrame:
    """Every row of ``df`` once per split that has it in ``part``, with common_seed, fold_id and times."""
    return _unpacked(df.join(packed(splits.filter(F.col("part") == part), key), key), part)


def _unpacked(rows: DataFrame, part: str) -> DataFrame:
    lists = [f"_{p}" for p in (ANALYSIS, ASSESSMENT)]
    return rows.select(*[c for c in rows.columns if c not in lists], F.inline(f"_{part}"))


def split_samples(features: DataFrame, splits: DataFrame, bags: DataFrame, label: str, ratio: float, key: str = "ind_id") -> tuple[DataFrame, DataFrame]:
    """(assessment rows of every split, training sample of every bag and split); analysis rows count as often as drawn.

    Cut-offs are counted per analysis set, as sets overlap and are not what a fold leaves. Rows meet their splits in one
    join; counting and choosing repeat narrow columns only.
    """
    rows = materialise(features.join(packed(splits, key), key))
    assessed = _unpacked(rows, ASSESSMENT).drop("times")
    return assessed, downsample_sets(_unpacked(rows, ANALYSIS), bags, label, ratio, key)
