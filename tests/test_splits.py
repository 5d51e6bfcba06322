"""Splits that overlap: sizes, draws, multiplicities, leaks and training on them."""

import hashlib
from collections import Counter

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import puspark as pu
from puspark.operators import splits as sp
from puspark.plans.training import draw_samples
from puspark.sources import materialise


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def people(spark):
    """200 rows, 29 of them positive."""
    return spark.range(200).select(
        F.col("id").alias("ind_id"),
        (F.col("id") % 7 == 3).cast("int").alias("known_pos"),
        (F.col("id") % 13).cast("double").alias("x"),
        (F.col("id") % 5).cast("double").alias("z"),
    )


def table(df):
    out = {}
    for r in df.collect():
        assert (r["common_seed"], r["fold_id"], r["ind_id"]) not in out
        out[r["common_seed"], r["fold_id"], r["ind_id"]] = (r["part"], r["times"])
    return out


def test_repeats_are_independent_partitions(people):
    got = table(pu.repeated_folds(people, 4, 3, [1, 2]))
    assert len(got) == 2 * 3 * 4 * 200
    for seed in (1, 2):
        for repeat in (1, 2, 3):
            order = sorted(range(200), key=lambda i: (md5(seed * 1000 + repeat, i), i))
            for place, i in enumerate(order):
                parts = [got[seed, f"Repeat{repeat}.Fold{f}", i] for f in range(1, 5)]
                assert parts == [("assessment" if f == place % 4 else "analysis", 1) for f in range(4)]


def test_monte_carlo_takes_the_exact_share_of_every_stratum(people):
    got = table(pu.monte_carlo_splits(people, 0.7, 3, [5], strata="known_pos"))
    for split in (1, 2, 3):
        for label in (0, 1):
            ids = [i for i in range(200) if (i % 7 == 3) == label]
            order = sorted(ids, key=lambda i: (md5(5000 + split, i), i))
            inside = {i for i in ids if got[5, f"Split{split}", i][0] == "analysis"}
            assert inside == set(order[: int(len(ids) * 0.7)])
    sets = [{i for i in range(200) if got[5, f"Split{s}", i][0] == "assessment"} for s in (1, 2, 3)]
    assert sets[0] & sets[1] and sets[0] != sets[1]


@pytest.mark.parametrize("strata", [None, "known_pos"])
def test_bootstrap_draws_as_many_rows_as_there_are(people, strata):
    got = table(pu.bootstrap_splits(people, 4, [8], strata=strata))
    for n in range(1, 5):
        own = {i: got[8, f"Bootstrap{n}", i] for i in range(200)}
        for ids in [range(200)] if strata is None else [[i for i in range(200) if (i % 7 == 3) == v] for v in (0, 1)]:
            label = 0 if strata is None else int(ids[0] % 7 == 3)
            order = sorted(ids, key=lambda i: (md5(8000 + n, i), i))
            picks = Counter(int(md5("pick", 8000 + n, label, j)[:15], 16) % len(order) for j in range(len(order)))
            assert {i: own[i] for i in ids} == {i: ("analysis", picks[p]) if picks[p] else ("assessment", 1) for p, i in enumerate(order)}
            assert sum(t for part, t in (own[i] for i in ids) if part == "analysis") == len(order)
    outside = sum(part == "assessment" for part, _ in got.values()) / len(got)
    assert 0.3 < outside < 0.44


def test_draws_do_not_depend_on_partitioning(people):
    for made in (lambda d: pu.bootstrap_splits(d, 2, [1]), lambda d: pu.monte_carlo_splits(d, 0.5, 2, [1])):
        assert table(made(people)) == table(made(people.repartition(13)))


def test_null_strata_empty_tables_and_wrong_numbers(spark, people):
    holes = people.withColumn("known_pos", F.when(F.col("ind_id") % 3 > 0, F.col("known_pos")))
    got = table(pu.bootstrap_splits(holes, 1, [1], strata="known_pos"))
    unknown = [got[1, "Bootstrap1", i] for i in range(0, 200, 3)]
    assert sum(t for part, t in unknown if part == "analysis") == len(unknown)
    assert pu.bootstrap_splits(people.limit(0), 2, [1]).count() == 0
    assert pu.monte_carlo_splits(people.limit(0), 0.5, 2, [1]).count() == 0
    with pytest.raises(ValueError):
        pu.monte_carlo_splits(people, 1.0, 2, [1])
    with pytest.raises(ValueError):
        pu.repeated_folds(people, 2, 1000, [1])
    twice = people.select("ind_id", "known_pos").unionByName(people.limit(1).select("ind_id", F.lit(7).alias("known_pos")))
    with pytest.raises(Exception, match="differing values of known_pos"):
        pu.bootstrap_splits(twice, 1, [1], strata="known_pos").collect()


def test_samples_of_overlapping_sets_equal_single_draws(spark, people):
    splits = materialise(pu.monte_carlo_splits(people, 0.6, 2, [1, 2], strata="known_pos"))
    bags = pu.make_bags(spark, [1, 2], 2)
    together = materialise(pu.downsample_sets(pu.members(people, splits, "analysis"), bags, "known_pos", 1.5))
    for bag in bags.collect():
        for name in ("Split1", "Split2"):
            mine = splits.filter((F.col("common_seed") == bag["common_seed"]) & (F.col("fold_id") == name) & (F.col("part") == "analysis"))
            alone = pu.downsample(people.join(mine.select("ind_id"), "ind_id"), "known_pos", 1.5, bag["recipe_seed"])
            got = together.filter((F.col("common_seed") == bag["common_seed"]) & (F.col("bag") == bag["bag"]) & (F.col("fold_id") == name))
            assert sorted(r["ind_id"] for r in got.collect()) == sorted(r["ind_id"] for r in alone.collect())


def test_copies_count_as_rows(spark, people):
    splits = materialise(pu.bootstrap_splits(people, 2, [3], strata="known_pos"))
    bags = pu.make_bags(spark, [3], 1)
    got = pu.downsample_sets(pu.members(people, splits, "analysis"), bags, "known_pos", 1.0).groupBy("fold_id", "known_pos").count().collect()
    assert {(r["fold_id"], r["known_pos"]): r["count"] for r in got} == {(f"Bootstrap{n}", v): 29 for n in (1, 2) for v in (0, 1)}
    whole = pu.downsample_sets(pu.members(people, splits, "analysis"), bags, "known_pos", 100.0)
    assert whole.count() == 2 * 200


@pytest.mark.parametrize(
    "made",
    [
        lambda d: pu.repeated_folds(d, 3, 2, [4], strata="known_pos"),
        lambda d: pu.monte_carlo_splits(d, 0.5, 2, [4], strata="known_pos"),
        lambda d: pu.bootstrap_splits(d, 2, [4], strata="known_pos"),
    ],
)
def test_no_model_is_assessed_on_its_training_rows(spark, people, made):
    splits = materialise(made(people))
    samples = draw_samples(people, splits, pu.make_bags(spark, [4], 2), 1.0)
    model = ["common_seed", "fold_id", "ind_id"]
    assert samples.training.join(samples.folded, model, "left_semi").count() == 0
    assessed = splits.filter("part = 'assessment'")
    assert samples.folded.count() == assessed.count() == samples.folded.join(assessed, model, "left_semi").count()
    assert samples.folded.columns == [*people.columns, "common_seed", "fold_id"]


def test_tuning_on_two_by_three_overlapping_splits(spark, people):
    splits = materialise(pu.repeated_folds(people, 3, 2, [4], strata="known_pos"))
    grid = spark.createDataFrame([(1, 3, 2)], "config int, num_trees int, max_depth int")
    stages = [VectorAssembler(inputCols=["x", "z"], outputCol="features")]
    got = pu.tune_cv(people, splits, pu.make_bags(spark, [4], 1), grid, stages, 1.0, RandomForestClassifier(labelCol="known_pos"))
    assert got.count() == 2 * 200
    assert got.select("fold_id").distinct().count() == 6
    assert got.groupBy("ind_id").count().filter("count <> 2").count() == 0
    assert pu.summarise_tuning(got).best.count() == 1


def test_wrong_split_tables_are_refused(spark, people):
    good = materialise(pu.monte_carlo_splits(people, 0.5, 1, [1]))
    cases = [
        (good.withColumn("part", F.lit("analysis")), "one part only"),
        (good.unionByName(good.filter("ind_id = 3")), "2 times in split"),
        (good.filter("ind_id <> 3"), "in no split"),
        (good.withColumn("times", F.lit(0)), "at least 1"),
        (good.withColumn("part", F.when(F.col("ind_id") != 3, F.col("part"))), "parts are"),
    ]
    for table_, message in cases:
        with pytest.raises(ValueError, match=message):
            sp.require_disjoint(people, table_)
