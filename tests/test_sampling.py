import hashlib

import pytest
from pyspark.sql import functions as F

import puspark as pu
from puspark.sources import materialise


def md5(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def people(spark):
    """200 rows, 30 of them positive, in unequal groups."""
    return spark.range(200).select(
        F.col("id").alias("ind_id"),
        (F.col("id") % 7 == 3).cast("int").alias("known_pos"),
        F.when(F.col("id") < 70, F.lit("big")).otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("source"),
    )


def rows_of(df, *columns):
    return {tuple(row[c] for c in columns) for row in df.collect()}


def test_folds_follow_the_draw(people):
    got = {(r["common_seed"], r["ind_id"]): r["fold_id"] for r in pu.assign_folds(people, 4, [1, 2]).collect()}
    for seed in (1, 2):
        order = sorted(range(200), key=lambda i: (md5(seed, i), i))
        assert {i: got[seed, i] for i in order} == {i: f"Fold{place % 4 + 1}" for place, i in enumerate(order)}


def test_folds_are_balanced_within_strata(people):
    folds = pu.assign_folds(people, 3, [5], strata="known_pos")
    sizes = folds.join(people, "ind_id").groupBy("known_pos", "fold_id").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["known_pos"] == label]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1


def test_group_stays_in_one_fold(people):
    folds = pu.assign_folds(people, 3, [5, 6], group="source").join(people, "ind_id")
    spread = folds.groupBy("common_seed", "source").agg(F.countDistinct("fold_id").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1
    assert folds.count() == 400
    assert folds.select("common_seed", "fold_id").distinct().count() == 6


def test_hot_group_is_placed_like_any_other(people):
    plain = rows_of(pu.assign_folds(people, 3, [5, 6], group="source"), "common_seed", "fold_id", "ind_id")
    assert rows_of(pu.assign_folds(people, 3, [5, 6], group="source", hot_rows=50), "common_seed", "fold_id", "ind_id") == plain
    assert len(plain) == 400


def test_rows_without_a_group_form_one(people):
    df = people.withColumn("source", F.when(F.col("ind_id") % 10 > 0, F.col("source")))
    folds = pu.assign_folds(df, 3, [5], group="source")
    assert folds.count() == 200
    assert folds.filter(F.col("ind_id") % 10 == 0).select("fold_id").distinct().count() == 1


def test_folds_do_not_depend_on_partitioning(people):
    a = pu.assign_folds(people, 3, [9], strata="known_pos")
    b = pu.assign_folds(people.repartition(13), 3, [9], strata="known_pos")
    assert rows_of(a, "ind_id", "fold_id") == rows_of(b, "ind_id", "fold_id")


def test_repeated_key_has_one_fold(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(i,) for i in range(2, 40)], "ind_id long")
    assert pu.assign_folds(df, 2, [1]).count() == 39


def test_strata_and_group_exclude_each_other(people):
    with pytest.raises(ValueError):
        pu.assign_folds(people, 3, [1], strata="known_pos", group="source")


def test_split_is_a_partition(people):
    folds = pu.assign_folds(people, 3, [1, 2])
    analysis, assessment = pu.split(people, folds, 2, "Fold3")
    a, b = rows_of(analysis, "ind_id"), rows_of(assessment, "ind_id")
    assert not a & b and len(a | b) == 200
    assert b == rows_of(pu.folds_for(folds, 2).filter("fold_id = 'Fold3'"), "ind_id")
    assert analysis.columns == people.columns


def test_bags(spark):
    rows = pu.make_bags(spark, [7, 9], 3).orderBy("counter").collect()
    assert [tuple(r) for r in rows] == [(s, b, s * 1000 + b, i) for i, (s, b) in enumerate([(s, b) for s in (7, 9) for b in (1, 2, 3)], 1)]


@pytest.mark.parametrize("ratio, sizes", [(1.0, (29, 29)), (2.0, (58, 29)), (0.5, (14, 14)), (100.0, (171, 29))])
def test_downsample_sizes_and_draw(people, ratio, sizes):
    got = pu.downsample(people, "known_pos", ratio, 42)
    for label, size in enumerate(sizes):
        ids = [i for i in range(200) if (i % 7 == 3) == (label == 1)]
        expected = {(i,) for i in sorted(ids, key=lambda i: (md5(42, i), i))[:size]}
        assert rows_of(got.filter(F.col("known_pos") == label), "ind_id") == expected
    assert got.columns == people.columns


def test_downsample_caps_unknown_labels_too(people):
    df = people.withColumn("known_pos", F.when(F.col("ind_id") >= 100, F.lit(None)).otherwise(F.col("known_pos")))
    counts = {r["known_pos"]: r["count"] for r in pu.downsample(df, "known_pos", 1.0, 1).groupBy("known_pos").count().collect()}
    assert counts == {0: 14, 1: 14, None: 14}


def test_edge_prefix_is_shared(people, monkeypatch):
    """One hash digit puts many rows on the cut-off prefix; the result must not change."""
    from puspark.operators import sampling

    expected = rows_of(pu.downsample(people, "known_pos", 1.0, 3), "ind_id")
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 1)
    assert rows_of(pu.downsample(people, "known_pos", 1.0, 3), "ind_id") == expected
    folded = rows_of(pu.assign_folds(people, 3, [2]), "ind_id", "fold_id")
    monkeypatch.setattr(sampling, "PREFIX_DIGITS", 6)
    assert rows_of(pu.assign_folds(people, 3, [2]), "ind_id", "fold_id") == folded


def test_all_bags_equal_single_draws(spark, people):
    folds = pu.assign_folds(people, 3, [1, 2], strata="known_pos")
    bags = pu.make_bags(spark, [1, 2], 2)
    together = materialise(pu.downsample_bags(pu.with_folds(people, folds), bags, "known_pos", 1.5))
    for bag in bags.collect():
        for fold in ("Fold1", "Fold2", "Fold3"):
            analysis, _ = pu.split(people, folds, bag["common_seed"], fold)
            alone = pu.downsample(analysis, "known_pos", 1.5, bag["recipe_seed"])
            mine = together.filter(
                (F.col("common_seed") == bag["common_seed"]) & (F.col("bag") == bag["bag"]) & (F.col("fold_id") == fold)
            )
            assert rows_of(mine, "ind_id") == rows_of(alone, "ind_id")


def test_latin_hypercube_uses_every_stratum_once(spark):
    rows = pu.latin_hypercube(spark, {"x": (0.0, 1.0), "k": (10, 20)}, 5, [1, 2]).collect()
    for seed in (1, 2):
        mine = [r for r in rows if r["common_seed"] == seed]
        assert sorted(round(r["x"], 9) for r in mine) == [0.1, 0.3, 0.5, 0.7, 0.9]
        assert sorted(r["k"] for r in mine) == [11, 13, 15, 17, 19]
    assert len({tuple(r["x"] for r in sorted(rows, key=lambda r: r["config"]) if r["common_seed"] == s) for s in (1, 2)}) == 2


def test_explicit_grid(spark):
    grid = spark.createDataFrame([(1, 10), (2, 20)], "config int, num_trees int")
    assert rows_of(pu.explicit_grid(pu.make_bags(spark, [3, 4], 2), grid), "common_seed", "config", "num_trees") == {
        (s, c, 10 * c) for s in (3, 4) for c in (1, 2)
    }


def test_differing_strata_of_an_entity_are_an_error(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "ind_id int, known_pos int")
    with pytest.raises(Exception, match="differing values of known_pos"):
        pu.assign_folds(df, 2, [1], strata="known_pos").collect()


def test_grid_has_distinct_configs_that_reach_both_ends(spark):
    got = pu.latin_hypercube(spark, {"max_depth": (2, 4)}, 30, [1, 2]).collect()
    assert sorted((r["common_seed"], r["max_depth"]) for r in got) == [(s, d) for s in (1, 2) for d in (2, 3, 4)]
    wide = pu.latin_hypercube(spark, {"max_depth": (2, 4), "rate": (0.0, 1.0)}, 9, [1]).collect()
    assert sorted(r["max_depth"] for r in wide) == [2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_cut_offs_beyond_one_broadcast(spark, monkeypatch):
    from puspark.operators import sampling

    df = spark.range(400).selectExpr("id as ind_id", "cast(id % 4 = 0 as int) as known_pos")
    folds = pu.assign_folds(df, 2, [1])
    folded = pu.with_folds(df, folds)
    bags = pu.make_bags(spark, [1], 3)
    whole = sorted(map(str, pu.downsample_bags(folded, bags, "known_pos", 1.0).collect()))
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", 5)
    assert sorted(map(str, pu.downsample_bags(folded, bags, "known_pos", 1.0).collect())) == whole
