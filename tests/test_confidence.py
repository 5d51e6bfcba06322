import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import puspark as pu
from puspark.functions import beta
from puspark.plans import classification


def scored(spark, entities, holdout=0, known_pos=0, known_neg=0):
    rows = [(i, holdout, known_pos, known_neg, None if s is None else float(s)) for i, scores in entities.items() for s in scores]
    return spark.createDataFrame(rows, "ind_id long, holdout int, known_pos int, known_neg int, score double")


def confidence(spark, entities, threshold):
    table = pu.entity_table(scored(spark, entities))
    got = pu.with_confidence(pu.classify(table, threshold), threshold).collect()
    return {r["ind_id"]: r for r in got}


def test_mean_leaves_missing_scores_out(spark):
    df = scored(spark, {1: [0.2, None, 0.4], 2: [float("nan"), 0.5], 3: [None]})
    means = {r["ind_id"]: r["score_mean"] for r in pu.ensemble_mean(df).collect()}
    assert means == {1: pytest.approx(0.3), 2: 0.5, 3: None}
    table = {r["ind_id"]: r for r in pu.entity_table(df).collect()}
    assert {i: r["n"] for i, r in table.items()} == {1: 2, 2: 1, 3: 0}
    assert {i: r["score_mean"] for i, r in table.items()} == means


def test_classification_is_strict(spark):
    df = spark.createDataFrame([(0.3,), (0.31,)], "score_mean double")
    assert [r["pred_class"] for r in pu.classify(df, 0.3).collect()] == [0, 1]


def test_beta_golden(spark):
    entities = {1: [0.2, 0.4, 0.5, 0.7]}
    stats = pu.beta_moments(pu.score_stats(scored(spark, entities))).first()
    assert (stats["shape1"], stats["shape2"]) == (pytest.approx(2.976923, abs=1e-6), pytest.approx(3.638462, abs=1e-6))
    assert (stats["mean_ln"], stats["mean_ln1m"]) == (pytest.approx(-0.893888, abs=1e-6), pytest.approx(-0.657772, abs=1e-6))
    above = confidence(spark, entities, 0.3)[1]
    assert (above["shape1"], above["shape2"]) == (pytest.approx(3.170752, abs=1e-6), pytest.approx(3.889249, abs=1e-6))
    assert above["pred_class"] == 1 and above["confidence"] == pytest.approx(0.78206, abs=1e-5)
    below = confidence(spark, {1: [0.2, 0.4, 0.5, 0.7]}, 0.6)[1]
    a, b = below["shape1"], below["shape2"]
    assert below["pred_class"] == 0
    assert below["confidence"] == pytest.approx(float(beta.upper_tail(np.array([a]), np.array([b]), 0.6, np.array([False]))[0]))


def test_entities_without_a_fit(spark):
    got = confidence(
        spark, {1: [1, 1, 1], 2: [0, 0], 3: [0.4], 4: [1], 5: [0.3, 0.3], 6: [0, 0.5], 7: [1, 0], 8: [None]}, 0.35
    )
    assert {i: r["conf_status"] for i, r in got.items()} == {
        1: "constant", 2: "constant", 3: "degenerate", 4: "degenerate", 5: "degenerate", 6: "boundary", 7: "boundary", 8: "degenerate",
    }
    assert {i: r["confidence"] for i, r in got.items()} == {1: 1.0, 2: 1.0, **{i: None for i in range(3, 9)}}


def test_fit_satisfies_the_likelihood_equations():
    rng = np.random.default_rng(1)
    groups = [rng.beta(a, b, size) for a, b in [(0.3, 0.3), (2, 9), (40, 3), (1, 1)] for size in (2, 3, 10, 50) for _ in range(20)]
    groups += [np.array([0.4, 0.4 + 1e-5]), np.array([1e-9, 0.999999999]), np.array([0.5, 0.5001, 0.4999])]
    stats = np.array([[x.mean(), x.var(), np.log(x).mean(), np.log1p(-x).mean()] for x in groups]).T
    a, b = beta.fit(*stats)
    with np.errstate(all="ignore"):
        # the score equations, scaled by the shapes as the digamma differences shrink with them
        left = (stats[2] - beta._digamma(a) + beta._digamma(a + b)) * np.minimum(a, 1)
        right = (stats[3] - beta._digamma(b) + beta._digamma(a + b)) * np.minimum(b, 1)
    assert np.abs(left).max() < 1e-8 and np.abs(right).max() < 1e-8
    assert (a > 0).all() and (b > 0).all()


@pytest.mark.parametrize("a, b", [(0.2, 0.3), (1.0, 1.0), (2.5, 7.0), (900.0, 40.0), (2e5, 3e5)])
def test_tail_against_integration(a, b):
    mean, sd = a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    for x in np.clip([mean - 2 * sd, mean - 0.5 * sd, mean, mean + sd], 0.01, 0.99):
        # logit scale: smooth integrand for every shape
        top = math.log(x / (1 - x))
        low = min(math.log(mean / (1 - mean)) - 60 * sd / (mean * (1 - mean)) - 60 / a, top - 1)
        z = np.linspace(low, top, 400_001)
        log_density = -a * np.log1p(np.exp(-z)) - b * np.log1p(np.exp(z)) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        expected = np.trapezoid(np.exp(log_density), z)
        got = beta.upper_tail(np.array([a, a]), np.array([b, b]), float(x), np.array([False, True]))
        assert got[0] == pytest.approx(expected, abs=2e-6)
        assert got.sum() == pytest.approx(1, abs=1e-12)


def test_tail_at_the_ends():
    a = np.array([2.0, 2.0])
    assert beta.upper_tail(a, a, 0.0, np.array([False, True])).tolist() == [0, 1]
    assert beta.upper_tail(a, a, 1.0, np.array([False, True])).tolist() == [1, 0]


def test_whole_classification(spark, preds):
    got = pu.classify_pu(preds)
    assert got.alpha == pytest.approx(0.168168, abs=1e-6)
    rows = got.scored.groupBy("conf_status").count().collect()
    assert {r["conf_status"]: r["count"] for r in rows} == {"degenerate": 115, "fitted": 1473 - 115}
    bad = got.scored.filter("conf_status = 'fitted' and not confidence between 0 and 1").count()
    assert bad == 0 and got.curve.filter("is_star").count() == 1
    metrics = pu.pu_metrics(got.scored).first()
    assert metrics["recall"] == pytest.approx(0.957447, abs=1e-6) and metrics["specif"] == 1.0


def test_entity_on_two_averaged_rows_is_refused(spark):
    df = scored(spark, {1: [0.2, 0.3]}).unionByName(scored(spark, {1: [0.5]}, known_pos=1))
    with pytest.raises(ValueError, match="differing"):
        pu.classify_pu(df)


def test_missing_label_beside_a_known_one_is_a_conflict(spark):
    df = scored(spark, {1: [0.2, 0.3], 2: [0.1]})
    half = df.withColumn("known_neg", F.when((F.col("ind_id") == 1) & (F.col("score") > 0.25), F.lit(None)).otherwise(F.col("known_neg")))
    assert {r["ind_id"]: r["conflict"] for r in pu.entity_table(half).collect()} == {1: True, 2: False}
    gone = df.withColumn("known_neg", F.lit(None).cast("int"))
    assert not any(r["conflict"] for r in pu.entity_table(gone).collect())


def test_entity_with_a_third_of_all_scores(spark):
    """Aggregates combine before the shuffle: nothing collects one entity's scores."""
    df = scored(spark, {1: [i / 1001 for i in range(1, 1001)], **{i: [0.2, 0.3] for i in range(2, 500)}})
    row = pu.entity_table(df.repartition(8)).filter("ind_id = 1").first()
    assert row["n"] == 1000 and row["score_mean"] == pytest.approx(0.5)
    plan = pu.entity_table(df)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "partial_" in plan


def test_metrics_golden(spark):
    rows = [(0, 1, 0, 1), (0, 1, 0, 1), (0, 1, 0, 0), (0, 0, 0, 1), (1, 0, 1, 0), (1, 0, 1, 0), (1, 0, 1, 1)]
    df = spark.createDataFrame(rows, "holdout int, known_pos int, known_neg int, pred_class int")
    row = pu.pu_metrics(df).first()
    assert row["recall"] == pytest.approx(2 / 3) and row["specif"] == pytest.approx(2 / 3)
    assert pu.recall(df).first()["recall"] == pytest.approx(2 / 3)
    odd = df.withColumn("pred_class", F.when(F.col("known_pos") == 1, 7).otherwise(F.col("pred_class")))
    assert pu.recall(odd).first()["recall"] is None
    by = {r["holdout"]: (r["recall"], r["specif"]) for r in pu.pu_metrics(df, ["holdout"]).collect()}
    assert by[1][0] is None and by[0][1] is None


def test_one_shuffle_for_the_entity_table(preds):
    """Means, Beta statistics and the conflict check share one pass."""
    plan = classification.entity_table(preds.select("ind_id", "holdout", "known_pos", "known_neg", "score"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(ind_id") <= 1
