"""Positions, partial running maximum and running median, in short and block-wise form."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import puspark as pu
from puspark.functions.medians import to_runs, window_kth
from puspark.operators.ordered import Windows, block_payload, median_window, range_medians
from tests import brute


def sequence(spark, values):
    rows = [(i + 1, 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rn long, n_rows long, r double")


def as_runs(spark, values):
    """The same sequence with equal neighbours held once."""
    rn, n_rows, r = to_runs(1, np.asarray(values, dtype=float))
    return spark.createDataFrame(list(zip(rn.tolist(), n_rows.tolist(), r.tolist())), "rn long, n_rows long, r double")


def values_of(runs, block_rows=1 << 18):
    rows = pu.expand_runs(runs, block_rows).orderBy("rn").collect()
    assert [row["rn"] for row in rows] == list(range(1, len(rows) + 1))
    return [row["r"] for row in rows]


def test_partial_running_max_golden(spark):
    rows = list(zip([1, 2, 3, 4, 5], [3.0, 1.0, 2.0, 0.5, 4.0], [0.1, 0.2, 0.6, 0.7, 0.9]))
    df = spark.createDataFrame(rows, "rn long, r double, y double")
    for block_rows in (1, 2, 100):
        got = pu.partial_running_max(df, block_rows=block_rows).orderBy("rn").collect()
        assert [row["r"] for row in got] == [3, 1, 2, 2, 4]


def test_partial_running_max_floor_and_blocks(spark):
    rng = np.random.default_rng(3)
    y = np.sort(rng.random(300))
    r = rng.normal(size=300)
    df = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(r, y))], "rn long, r double, y double")
    got = pu.partial_running_max(df, block_rows=17).orderBy("rn").collect()
    assert [row["r"] for row in got] == brute.running_max(r.tolist(), y.tolist())


@pytest.mark.parametrize(
    "values, half, expected",
    [
        ([5, 1, 4, 2, 3], 1, [5, 4, 2, 3, 3]),
        ([9, 1, 8, 2, 7, 3, 6], 2, [7, 7, 7, 3, 6, 6, 6]),
        ([9, 1, 8, 2, 7, 3, 6, 0, 5, 4], 3, [9, 8, 6, 6, 3, 5, 4, 4, 4, 4]),
    ],
)
def test_running_median_golden(spark, values, half, expected):
    assert brute.running_median(values, half) == expected
    n = len(values)
    denom = n / (2 * half + 1)
    assert median_window(n, denom) == 2 * half + 1
    for block_rows in (2, 3, 100):
        assert values_of(pu.rolling_median(sequence(spark, values), n, denom, block_rows)) == expected


@pytest.mark.parametrize("n, size", [(19, 1), (39, 1), (40, 3), (59, 3), (60, 3), (100, 5), (14743, 737), (10796, 539)])
def test_median_window(n, size):
    assert median_window(n) == size


def test_median_window_longer_than_data():
    assert median_window(6, 0.5) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4)), min_size=1, max_size=20), st.data())
def test_window_kth_counts_weights(items, data):
    values, weights = [v for v, _ in items], [w for _, w in items]
    start = data.draw(st.integers(0, len(items) - 1))
    stop = data.draw(st.integers(start + 1, len(items)))
    flat = sorted(v for v, w in items[start:stop] for _ in range(w))
    kth = data.draw(st.integers(0, len(flat) - 1))
    assert window_kth(values, weights, [start], [stop], [kth])[0] == flat[kth]


def shapes(n):
    rng = np.random.default_rng(11)
    bump = np.exp(-(((np.arange(n) - n / 3) / (n / 9)) ** 2))
    return {
        "random": rng.normal(size=n),
        "rising": np.arange(n) / n,
        "few values": rng.integers(0, 4, n).astype(float),
        "a third equal": np.where(np.arange(n) % 3 == 0, 1.0, rng.normal(size=n)),
        "flat top": np.maximum.accumulate(bump),
        "one value": np.full(n, 2.5),
    }


@pytest.mark.parametrize("name", list(shapes(10)))
def test_block_medians_match_brute_force(spark, name):
    """Windows many blocks long, so that cores are reduced to their middle band."""
    n, half, size = 600, 120, 20
    values = shapes(n)[name]
    windows = Windows(half + 1, n - half, (1, -half), (1, half))
    got = values_of(range_medians(as_runs(spark, values), windows, size).withColumn("rn", F.col("rn") - half))
    assert got == [brute.middle(values[i - half : i + half + 1]) for i in range(half, n - half)]


@pytest.mark.parametrize("name", ["random", "a third equal", "flat top"])
def test_block_medians_keep_tasks_small(spark, name):
    """What one block's task receives does not grow with the window."""
    n, size = 4000, 20
    runs = as_runs(spark, shapes(n)[name])
    for half in (200, 800):
        sent = block_payload(runs, Windows(half + 1, n - half, (1, -half), (1, half)), size)
        held = F.sum(F.when(F.col("kind") == 0, F.col("n_rows")).otherwise(1))
        assert sent.groupBy("q").agg(held.alias("held")).agg(F.max("held")).first()[0] <= 16 * size


@pytest.mark.parametrize("name", list(shapes(10)))
def test_rolling_median_is_the_same_at_any_block_size(spark, name):
    n = 900
    values = shapes(n)[name]
    expected = brute.running_median(values, (median_window(n, 3) - 1) // 2)
    assert values_of(pu.rolling_median(as_runs(spark, values), n, 3)) == expected
    assert values_of(pu.rolling_median(as_runs(spark, values), n, 3, block_rows=16), 16) == expected


@pytest.mark.parametrize("values, half", [([3, 1, 2], 1), ([2, 2, 5, 1], 1), ([4, 1, 3, 5, 2], 2), ([1] * 7, 3)])
def test_rolling_median_of_very_short_sequences(spark, values, half):
    n = len(values)
    for block_rows in (1, 2, 50):
        got = values_of(pu.rolling_median(sequence(spark, values), n, n / (2 * half + 1), block_rows))
        assert got == brute.running_median(values, half)


@pytest.mark.parametrize("value", [None, float("nan")])
def test_missing_value_is_an_error(spark, value):
    runs = spark.createDataFrame([(k + 1, 1, 1.0 if k != 4 else value) for k in range(60)], "rn long, n_rows long, r double")
    with pytest.raises(Exception, match="missing"):
        pu.rolling_median(runs, 60).collect()


def test_median_has_a_group_per_block(spark, monkeypatch):
    """No plan gathers the sequence in one group, however short it is."""
    from pyspark.sql import GroupedData

    grouped = []
    held = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a, **b: grouped.append(str(self)) or held(self, *a, **b))
    pu.rolling_median(as_runs(spark, shapes(50)["random"]), 50, 3)
    assert grouped and all("q" in g for g in grouped)


def test_edges_take_a_few_rows_per_block(spark):
    from puspark.operators.scan import EDGE_ROWS, bucket_edges

    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000 / 200_000).alias("y"))
    edges = bucket_edges(df, "y", 200_000, 2_000)
    assert len(edges) == 99 and all(abs(e - (k + 1) / 100) < 0.03 for k, e in enumerate(edges))
    assert bucket_edges(df, "y", 100, 2_000) == [] and EDGE_ROWS * 100 < 200_000


def test_positions(spark):
    scores = [0.5] * 40 + [0.1, 0.1, 0.9, 0.3] * 5
    df = spark.createDataFrame([(s,) for s in scores], "y double")
    for block_rows in (3, 1000):
        got = pu.with_position(df, "y", block_rows=block_rows).orderBy("rn").collect()
        assert [(row["y"], row["rn"], row["n_rows"]) for row in got] == [(0.1, 1, 10), (0.3, 11, 5), (0.5, 16, 40), (0.9, 56, 5)]
