import numpy as np
import pytest

import puspark as pu
from puspark.sources import tuning_predictions
from tests import brute


def labelled(spark, rows):
    return spark.createDataFrame(rows, "g string, known_pos int, score double")


def test_auc_golden(spark):
    df = labelled(spark, [("a", 1, 0.9), ("a", 1, 0.8), ("a", 0, 0.8), ("a", 0, 0.3)])
    assert pu.grouped_auc(df, ["g"]).first()["auc"] == 0.875


@pytest.mark.parametrize("block_rows", [1, 1 << 18])
def test_auc_undefined_groups(spark, block_rows):
    df = labelled(spark, [("a", 1, 0.9), ("b", 0, 0.1), ("c", None, 0.5), ("d", 1, None), (None, 1, 0.7), (None, 0, 0.2)])
    assert {r["g"]: r["auc"] for r in pu.grouped_auc(df, ["g"], block_rows=block_rows).collect()} == {"a": None, "b": None, "c": None, "d": None, None: 1.0}


@pytest.mark.parametrize("block_rows", [4, 1 << 18])
def test_auc_against_pairs(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = [(g, int(k), float(s)) for g in "xy" for k, s in zip(rng.integers(0, 2, 80), rng.integers(0, 20, 80) / 20)]
    rows += [("x", k, 0.5) for k in (0, 1) for _ in range(30)]  # one score with many rows
    got = {r["g"]: r["auc"] for r in pu.grouped_auc(labelled(spark, rows), ["g"], block_rows=block_rows).collect()}
    for g in "xy":
        mine = [r for r in rows if r[0] == g]
        assert got[g] == pytest.approx(brute.auc([r[1] for r in mine], [r[2] for r in mine]), abs=1e-12)


def test_auc_of_mirrored_scores(spark, small):
    auc = pu.auc_by_fold(tuning_predictions(spark, small), block_rows=100)
    by = {(r["common_seed"], r["fold_id"], r["config"]): r["auc"] for r in auc.collect()}
    for seed, fold, config in by:
        if config == 1:
            assert by[seed, fold, 1] + by[seed, fold, 2] == pytest.approx(1, abs=1e-12)


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="counter"):
        pu.auc_by_fold(spark.createDataFrame([(1, 1, 1, 0.5, 1, "f")], "common_seed int, bag int, known_pos int, score double, ind_id int, fold_id string"))


def fold_aucs(spark, rows):
    return spark.createDataFrame(rows, "common_seed int, fold_id string, trees int, auc double")


def test_summary_keeps_missing_folds_missing(spark):
    got = pu.auc_summary(fold_aucs(spark, [(1, "a", 10, 0.8), (1, "b", 10, None), (1, "a", 20, 0.5), (1, "b", 20, 0.7)]))
    rows = {r["trees"]: (r["mean_auc"], r["min_auc"]) for r in got.collect()}
    assert rows == {10: (None, None), 20: (pytest.approx(0.6), 0.5)}


def test_best_config_ties_and_missing(spark):
    df = spark.createDataFrame(
        [(1, 30, 0.7, 0.1), (1, 20, 0.7, 0.2), (1, 10, None, None), (2, 5, None, None)],
        "common_seed int, trees int, mean_auc double, min_auc double",
    )
    best = pu.best_config(df)
    assert best.columns == ["common_seed", "trees"]
    assert {tuple(r) for r in best.collect()} == {(1, 20), (2, 5)}
