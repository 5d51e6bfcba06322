"""Folds of whole groups, strata of a number, and rates of categories: bounds, brute force and leaks."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import puspark as pu
from puspark.operators import balance
from puspark.sources import materialise


def table(spark, sizes, positives):
    rows, n = [], 0
    for g, (size, pos) in enumerate(zip(sizes, positives)):
        for j in range(size):
            rows.append((n, f"g{g}" if g else None, int(j < pos)))
            n += 1
    return spark.createDataFrame(rows, "ind_id long, source string, known_pos int").repartition(4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(2, 5))
def test_packing_stays_within_the_largest_group(sizes, k):
    placed, loads = balance.pack([(i, [n]) for i, n in enumerate(sizes)], [sum(sizes)], k)
    totals = Counter()
    for i, n in enumerate(sizes):
        totals[placed[i]] += n
    assert [totals[f] for f in range(1, k + 1)] == [sum(load) for load in loads]
    assert max(map(sum, loads)) - min(map(sum, loads)) <= max(sizes)


@pytest.mark.parametrize("heavy", [500, 4, 0.01])
def test_groups_stay_whole_and_folds_even(spark, heavy):
    """One path for large groups, one for the rest; both keep groups whole and folds within the largest group."""
    rng = random.Random(1)
    sizes = [40, 25, *[rng.randrange(1, 8) for _ in range(120)]]
    positives = [rng.randrange(0, n // 3 + 1) for n in sizes]
    df = table(spark, sizes, positives)
    folds = pu.balanced_group_folds(df, 3, [5, 6], "source", "known_pos", heavy_per_fold=heavy)
    rows = folds.join(df, "ind_id").collect()
    assert len(rows) == 2 * sum(sizes)
    for seed in (5, 6):
        mine = [r for r in rows if r["common_seed"] == seed]
        assert all(len({r["fold_id"] for r in mine if r["source"] == g}) == 1 for g in {r["source"] for r in mine})
        for label in (None, 0, 1):
            size = Counter(r["fold_id"] for r in mine if label is None or r["known_pos"] == label)
            assert len(size) == 3 and max(size.values()) - min(size.values()) <= max(sizes)
    split = {seed: {r["ind_id"]: r["fold_id"] for r in rows if r["common_seed"] == seed} for seed in (5, 6)}
    assert split[5] != split[6]


def test_group_folds_on_awkward_tables(spark):
    assert pu.balanced_group_folds(table(spark, [], []), 3, [1], "source", "known_pos").count() == 0
    assert pu.balanced_group_folds(table(spark, [7], [2]), 3, [1], "source").select("fold_id").distinct().count() == 1
    twice = spark.createDataFrame([(1, "a", 0), (1, "b", 0)], "ind_id long, source string, known_pos int")
    with pytest.raises(ValueError, match="differing values of source"):
        pu.balanced_group_folds(twice, 2, [1], "source")
    same = pu.balanced_group_folds(table(spark, [9, 4, 4], [1, 1, 1]), 2, [3], "source", "known_pos", hot_rows=5)
    assert same.count() == 17


def test_strata_of_a_number(spark):
    rng = random.Random(2)
    values = [rng.choice([None, float("nan"), 0.0, -0.0, 5.0, rng.random() * 10]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "ind_id int, x double").repartition(5)
    got = {r["ind_id"]: r["stratum"] for r in pu.numeric_strata(df, "x", 5, 0.0, block_rows=32).collect()}
    known = sorted(v for v in values if v is not None and v == v)
    bin_of = {v: sum(u < v for u in known) * 5 // len(known) for v in known}
    dense = {b: i for i, b in enumerate(sorted(set(bin_of.values())))}
    assert got == {i: None if v is None or v != v else dense[bin_of[v]] for i, v in enumerate(values)}
    pooled = pu.numeric_strata(df, "x", 5, 0.3).filter("stratum is not null").groupBy("stratum").count().collect()
    assert all(r["count"] >= 0.3 * len(known) for r in pooled) and len(pooled) > 1
    assert pu.numeric_strata(df.limit(0), "x").count() == 0
    assert pu.numeric_strata(df.filter("x is null"), "x").select("stratum").distinct().collect() == [(None,)]


def test_sparse_bins_join_their_smaller_neighbour():
    assert balance.pooled_edges([0, 1, 2, 3], [5, 1, 4, 10], 2) == [0, 1, 3]
    assert balance.pooled_edges([0, 1, 2, 3], [1, 5, 1, 4], 3) == [0, 2]
    assert balance.pooled_edges([0, 1], [1, 1], 9) == [0]


def test_rates_leave_the_own_fold_out(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"rare{i}"]), rng.choice([0, 1, 1, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "ind_id long, source string, known_pos int").repartition(3)
    folds = pu.assign_folds(df, 3, [1, 2])
    folded = materialise(pu.with_folds(df, folds))
    got = {(r["common_seed"], r["ind_id"]): r["source_rate"] for r in pu.with_target_rates(folded, ["source"], "known_pos", 5.0, hot_rows=20).collect()}
    of = {(r["common_seed"], r["ind_id"]): r["fold_id"] for r in folds.collect()}
    assert len(got) == 400
    for (seed, i), rate in got.items():
        rest = [r for r in rows if of[seed, r[0]] != of[seed, i] and r[2] is not None]
        same = [r for r in rest if r[1] == rows[i][1]]
        overall = sum(r[2] for r in rest) / len(rest)
        assert abs(rate - (sum(r[2] for r in same) + 5 * overall) / (len(same) + 5)) < 1e-12
    # labels of the row's own fold change nothing
    flipped = df.join(folds.filter("common_seed = 1 and fold_id = 'Fold1'").select("ind_id", F.lit(1).alias("own")), "ind_id", "left")
    flipped = flipped.withColumn("known_pos", F.when(F.col("own") == 1, 1 - F.col("known_pos")).otherwise(F.col("known_pos"))).drop("own")
    again = pu.with_target_rates(materialise(pu.with_folds(flipped, folds)), ["source"], "known_pos", 5.0).filter("common_seed = 1 and fold_id = 'Fold1'").collect()
    assert again and all(abs(r["source_rate"] - got[1, r["ind_id"]]) < 1e-12 for r in again)
    assert pu.with_target_rates(folded.limit(0), ["source"], "known_pos").count() == 0


def test_bounds_that_depend_on_the_data(spark):
    from pyspark.ml.classification import RandomForestClassifier

    from puspark.plans.training import ModelKey, _configured

    df = spark.createDataFrame([(i, int(i < 45), 0.0, 0.0) for i in range(200)], "ind_id int, known_pos int, a double, b double")
    assert pu.data_ranges(df, "known_pos", ["a", "b"]) == {"features_per_split": (1, 2), "min_instances_per_node": (2, 4)}
    assert pu.data_ranges(df.limit(0), "known_pos", ["a"])["min_instances_per_node"] == (2, 2)
    key = ModelKey(1, 1, 1, "Fold1", (("config", 1), ("features_per_split", 3), ("min_rows_share", 0.01)))
    forest = _configured(RandomForestClassifier(), key, {}, 150)
    assert forest.getFeatureSubsetStrategy() == "3" and forest.getMinInstancesPerNode() == 2
