"""Densities, D curve, threshold and the whole estimate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import puspark as pu
from puspark.operators.density import collect_plan
from puspark.plans.prior_estimation import monotone
from tests import brute


def ratio(spark, values):
    return spark.createDataFrame([(float(v), 1) for v in values], "r double, n_rows long")


def test_curve_golden(spark):
    curve = pu.prior_curve(ratio(spark, [0.5, 2]), 5).orderBy("i").collect()
    assert [row["d"] for row in curve] == pytest.approx([0, -0.0625, -0.125, 0.0625, 0.25], abs=1e-12)
    assert [row["d2"] for row in curve[1:-1]] == pytest.approx([0, 0.25, 0], abs=1e-12)
    assert curve[0]["d2"] is None and curve[-1]["d2"] is None
    assert [row["is_star"] for row in curve] == [False, False, True, False, False]
    assert pu.prior_from_curve(pu.prior_curve(ratio(spark, [0.5, 2]), 5)).first()["alpha"] == 0.5


@pytest.mark.parametrize("steps", [3, 10, 1000])
def test_curve_equals_matrix_form(spark, steps):
    rng = np.random.default_rng(2)
    r = np.concatenate((rng.gamma(1.0, 2.0, 200), [0.0, 0.0, 1.0, 2.0, 999.0, 1e7]))
    alpha, d = brute.curve(r, steps)
    got = pu.prior_curve(ratio(spark, r), steps).orderBy("i").collect()
    assert [row["alpha"] for row in got] == pytest.approx(alpha.tolist())
    assert [row["d"] for row in got] == pytest.approx(d.tolist(), abs=1e-12)
    assert all(row["d2"] > -1e-12 for row in got[1:-1])  # convex in alpha


def test_curve_ties_take_smallest_alpha(spark):
    got = pu.prior_curve(ratio(spark, [0.0, 0.0]), 6)
    assert pu.prior_from_curve(got).first()["alpha"] == pytest.approx(0.2)


def test_curve_needs_three_steps(spark):
    with pytest.raises(ValueError):
        pu.prior_curve(ratio(spark, [1.0]), 2)


def scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "y double")


@pytest.mark.parametrize("alpha, threshold, matched", [(0.5, 0.59, True), (0.3, 0.0, False)])
def test_threshold_golden(spark, alpha, threshold, matched):
    sweep = pu.threshold_sweep(scores(spark, [0.1, 0.4, 0.6, 0.9]))
    row = pu.pick_threshold(sweep, alpha).first()
    assert row["threshold"] == pytest.approx(threshold) and row["matched"] is matched


def test_threshold_is_strict_and_keeps_list_order(spark):
    listed = [0.5, 0.2, 0.9, 0.2]
    sweep = pu.threshold_sweep(scores(spark, [0.2, 0.5, 0.5, 1.0]), listed).orderBy("idx").collect()
    assert [row["threshold"] for row in sweep] == listed
    assert [row["n_above"] for row in sweep] == [1, 3, 1, 3]
    # two listed values give 1/4; the last one listed wins, though it is larger
    row = pu.pick_threshold(pu.threshold_sweep(scores(spark, [0.2, 0.5, 0.5, 1.0]), listed), 0.25).first()
    assert row["threshold"] == 0.9
    # nothing fits: the first one listed
    assert pu.pick_threshold(pu.threshold_sweep(scores(spark, [0.2]), listed), 0.5).first()["threshold"] == 0.5


def test_sweep_equals_filters(spark, assessment):
    unlabeled = assessment.filter("known_pos = 0").select(F.col("score_mean").alias("y"))
    y = np.array([row["y"] for row in unlabeled.collect()])
    for row in pu.threshold_sweep(unlabeled).collect():
        assert row["n_above"] == int((y > row["threshold"]).sum())


def entities(spark, pos, unl):
    rows = [(1, float(v)) for v in pos] + [(0, float(v)) for v in unl]
    return spark.createDataFrame(rows, "known_pos int, score_mean double")


def test_kde_plan_golden(spark):
    plans = collect_plan(pu.kde_plan(entities(spark, [0.1, 0.4, 0.6, 0.9], [0.1, 0.4, 0.6, 0.9])))
    for plan in plans.values():
        assert plan.bandwidth == pytest.approx(0.291845830, abs=1e-9)
        assert plan.start == pytest.approx(-1.067383320, abs=1e-9)
        assert plan.start + 400 * plan.step == pytest.approx(2.067383320, abs=1e-9)


def test_densities_against_direct_sums(spark):
    rng = np.random.default_rng(8)
    pos, unl = rng.beta(5, 2, 60), np.concatenate((rng.beta(2, 4, 100), [0.25] * 40))
    dens = pu.densities(entities(spark, pos, unl))

    def grid(x):
        n, sd = len(x), np.std(x, ddof=1)
        h = (1 / (4 * math.pi)) ** 0.1 * (243 / (35 * n)) ** 0.2 * sd
        points = np.linspace(min(x) - 4 * h, max(x) + 4 * h, 401)
        step = points[1] - points[0]
        weight = np.zeros(401)
        for v in x:
            place = (v - points[0]) / step
            cell = int(place)
            weight[cell] += 1 - (place - cell)
            weight[cell + 1] += place - cell
        reach = min(int(4 * h / step), 401)
        lags = np.arange(-reach, reach + 1)
        kernel = np.exp(-0.5 * (lags * step / h) ** 2)
        kernel /= kernel.sum() * step * n
        return points, np.convolve(weight, kernel)[reach : reach + 401]

    for row in dens.at_unlabeled.collect():
        for name, x in (("f_pos", pos), ("f_unl", unl)):
            points, f = grid(x)
            assert row[name] == pytest.approx(np.interp(row["y"], points, f), rel=1e-9, abs=1e-12)
    counted = {round(row["y"], 12): row["n_rows"] for row in dens.at_unlabeled.collect()}
    assert counted[0.25] == 40 and sum(counted.values()) == 140


def test_positive_density_is_flat_beyond_its_grid(spark):
    got = pu.densities(entities(spark, [0.5, 0.51, 0.52], [0.0, 0.5, 1.0])).at_unlabeled.orderBy("y").collect()
    assert got[0]["f_pos"] >= 0 and got[0]["f_pos"] == pytest.approx(got[2]["f_pos"], abs=1e-3)


@pytest.mark.parametrize("pos, unl", [([], [0.1, 0.2]), ([0.5], [0.1, 0.2]), ([0.5, 0.5], [0.1, 0.2]), ([0.4, 0.5], [])])
def test_undefined_densities_are_refused(spark, pos, unl):
    with pytest.raises(ValueError):
        pu.densities(entities(spark, pos, unl))


def test_upper_ratio_rises(assessment):
    dens = pu.densities(assessment)
    rows = [(row["y"], row["r"]) for row in monotone(dens, 50).orderBy("y").collect()]
    upper = [r for y, r in rows if y > dens.plans[0].mean]
    assert upper == sorted(upper) and len(upper) > 10


def test_whole_chain_golden(spark, assessment):
    found = pu.calibrate_threshold(assessment)
    plans = collect_plan(pu.kde_plan(assessment))
    assert (plans[1].n, plans[0].n) == (94, 1082)
    assert (plans[1].reach, plans[0].reach) == (94, 53)
    assert plans[1].bandwidth == pytest.approx(0.041738, abs=1e-6)
    assert plans[0].bandwidth == pytest.approx(0.043165, abs=1e-6)
    assert found.prior.alpha == pytest.approx(0.168168, abs=1e-6)
    assert found.threshold == pytest.approx(0.60)
    assert found.share == pytest.approx(0.163586, abs=1e-6)
    assert found.matched
    ratios = pu.density_ratio(pu.densities(assessment))
    assert ratios.agg(F.max("r")).first()[0] == pytest.approx(6.843731, abs=1e-6)
    assert ratios.agg(F.sum("n_rows")).first()[0] == 1082


def test_block_size_and_partitioning_do_not_matter(assessment):
    whole = pu.estimate_prior(assessment, steps=200)
    parts = pu.estimate_prior(assessment.repartition(7), steps=200, block_rows=11)
    assert parts.alpha == whole.alpha
    for a, b in zip(whole.curve.orderBy("i").collect(), parts.curve.orderBy("i").collect()):
        assert a["d"] == pytest.approx(b["d"], abs=1e-12)


def test_score_shared_by_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    unl = np.concatenate((rng.beta(2, 5, 200), np.full(100, 0.75)))
    df = entities(spark, rng.beta(6, 2, 80), unl)
    small, blocks = pu.estimate_prior(df, steps=100), pu.estimate_prior(df, steps=100, block_rows=8)
    assert small.alpha == blocks.alpha
    for a, b in zip(small.curve.orderBy("i").collect(), blocks.curve.orderBy("i").collect()):
        assert a["d"] == pytest.approx(b["d"], abs=1e-12)
