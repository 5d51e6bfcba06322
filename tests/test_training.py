import time
from types import SimpleNamespace

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

import puspark as pu
from puspark.plans.training import draw_samples, model_keys
from puspark.plans import training
from puspark.sources import document_features, materialise
from registered.documents import NAME_BINS, with_name_bins


def stages():
    return [
        StringIndexer(inputCol="lang", outputCol="lang_ix", handleInvalid="keep"),
        VectorAssembler(inputCols=["n_chars", "n_words", "digit_share", "lang_ix"], outputCol="features"),
    ]


@pytest.fixture(scope="module")
def table(spark, small):
    return materialise(document_features(spark, small))


@pytest.fixture(scope="module")
def features(table):
    return table.filter("known_neg = 0")


@pytest.fixture(scope="module")
def folds(features):
    return materialise(pu.assign_folds(features, 2, [3], strata="known_pos"))


def forest():
    return RandomForestClassifier(labelCol="known_pos")


def test_tuning_scores(spark, features, folds):
    grid = spark.createDataFrame([(1, 3, 2), (2, 5, 3)], "config int, num_trees int, max_depth int")
    bags = pu.make_bags(spark, [3], 1)
    got = pu.tune_cv(features, folds, bags, grid, stages(), 1.0, forest())
    assert set(got.columns) == {
        "common_seed", "bag", "counter", "fold_id", "config", "num_trees", "max_depth", "ind_id", "known_pos", "score",
    }
    n = features.count()
    assert got.count() == 2 * n
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    # every row is scored by the models of its own fold, which were not trained on it
    assert got.join(folds, ["common_seed", "fold_id", "ind_id"], "left_semi").count() == 2 * n
    summary = pu.summarise_tuning(got)
    assert summary.auc.count() == 2 and summary.best.count() == 1


def test_training_samples_leave_the_fold_out(spark, features, folds):
    bags = pu.make_bags(spark, [3], 2)
    samples = draw_samples(features, folds, bags, 1.0)
    assert samples.training.join(folds, ["common_seed", "fold_id", "ind_id"], "left_semi").count() == 0
    sizes = samples.training.groupBy("bag", "fold_id", "known_pos").count().collect()
    assert len(sizes) == 8
    for bag in (1, 2):
        for fold in ("Fold1", "Fold2"):
            assert len({r["count"] for r in sizes if r["bag"] == bag and r["fold_id"] == fold}) == 1


def test_prediction_with_and_without_holdout(spark, table, features, folds):
    bags = pu.make_bags(spark, [3], 2)
    params = {"num_trees": 3, "max_depth": 2}
    holdout = table.filter("known_neg = 1")
    both = pu.fit_predict_cv(features, folds, bags, stages(), 1.0, params, holdout, forest())
    alone = pu.fit_predict_cv(features, folds, bags, stages(), 1.0, params, None, forest())
    models = 2 * 2
    assert both.filter("holdout = 1").count() == models * holdout.count()
    assert both.filter("holdout = 0").count() == 2 * features.count()
    assert alone.filter("holdout = 1").count() == 0
    keys = ["common_seed", "bag", "fold_id", "ind_id"]
    # same seed, same forest: the scores agree
    paired = both.filter("holdout = 0").join(alone.withColumnRenamed("score", "again"), keys)
    assert paired.count() == alone.count()
    assert paired.filter(F.abs(F.col("score") - F.col("again")) > 1e-12).count() == 0


def test_model_keys(spark, folds):
    bags = pu.make_bags(spark, [3], 2)
    assert [(k.bag, k.fold_id) for k in model_keys(folds, bags)] == [(1, "Fold1"), (1, "Fold2"), (2, "Fold1"), (2, "Fold2")]
    grid = spark.createDataFrame([(1, 4)], "config int, num_trees int")
    assert model_keys(folds, bags, grid)[0].params == (("config", 1), ("num_trees", 4))


def test_repeated_entity_is_refused(spark, features, folds):
    with pytest.raises(ValueError, match="rows"):
        draw_samples(features.unionByName(features.limit(1)), folds, pu.make_bags(spark, [3], 1), 1.0)


def test_overlapping_folds_are_refused(spark, features, folds):
    bags = pu.make_bags(spark, [3], 1)
    twice = folds.unionByName(folds.limit(3).withColumn("fold_id", F.lit("Fold9")))
    with pytest.raises(ValueError, match="2 folds of seed 3"):
        draw_samples(features, twice, bags, 1.0)


def test_entities_without_a_fold_are_refused(spark, features, folds):
    bags = pu.make_bags(spark, [3], 1)
    with pytest.raises(ValueError, match="has no fold in 1 of 1 seeds"):
        draw_samples(features, folds.filter("ind_id % 7 <> 0"), bags, 1.0)
    two = folds.unionByName(folds.filter("ind_id % 7 <> 0").withColumn("common_seed", F.lit(4)))
    with pytest.raises(ValueError, match="has no fold in 1 of 2 seeds"):
        draw_samples(features, two, bags, 1.0)


def test_several_seeds_and_chunks(spark, features, monkeypatch):
    """Both seeds are tuned, and no more forests than one chunk's are held at a time."""
    alive = []
    fit = training.fit_models

    def watched(*args, **options):
        import gc
        import weakref

        for chunk in fit(*args, **{**options, "nodes": 1}):
            gc.collect()
            assert sum(r() is not None for r in alive) == 0
            alive.extend(weakref.ref(m.model) for m in chunk)
            yield chunk
            del chunk

    monkeypatch.setattr(training, "fit_models", watched)
    folds = materialise(pu.assign_folds(features, 2, [3, 4], strata="known_pos"))
    grid = spark.createDataFrame([(1, 2, 2), (2, 3, 2)], "config int, num_trees int, max_depth int")
    got = pu.tune_cv(features, folds, pu.make_bags(spark, [3, 4], 1), grid, stages(), 1.0, forest(), parallelism=1)
    assert got.count() == 2 * 2 * features.count()
    # every tree is a slice of its own
    assert len(alive) == 2 * 2 * (2 + 3)
    assert pu.summarise_tuning(got).best.count() == 2


def test_forest_takes_more_names_than_bins(spark, features, folds):
    many = with_name_bins(features.withColumn("source", F.concat(F.lit("s"), F.col("ind_id"))))
    assert many.select("source").distinct().count() > NAME_BINS
    steps = [VectorAssembler(inputCols=["n_words", "lang_bin", "source_bin"], outputCol="features")]
    params = {"num_trees": 2, "max_depth": 2}
    got = pu.fit_predict_cv(many, folds, pu.make_bags(spark, [3], 1), steps, 1.0, params, None, RandomForestClassifier(labelCol="known_pos", maxBins=NAME_BINS))
    assert got.count() == features.count()


def test_nothing_to_fit_is_an_error(spark, features, folds):
    with pytest.raises(ValueError, match="no model"):
        pu.fit_predict_cv(features, folds, pu.make_bags(spark, [99], 1), stages(), 1.0, None, None, forest())


def test_slices_hold_the_bound_and_add_up(spark, features, folds):
    """A forest of ten times the bound is fitted in slices below it; its scores are the trees' mean votes."""
    bags = pu.make_bags(spark, [3], 1)
    samples = draw_samples(features, folds, bags, 1.0)
    params, bound = {"num_trees": 20, "max_depth": 4}, 2 * 31
    keys = model_keys(folds, bags)
    fitted = [m for chunk in training.fit_models(samples.training, keys, stages(), forest(), params, 3, bound) for m in chunk]
    assert all(m.nodes <= bound and m.trees == 2 and m.all_trees == 20 for m in fitted)
    assert sum(m.nodes for m in fitted) > 5 * bound and len(fitted) == 2 * 10
    want = {}
    for m in fitted:
        rows = m.model.transform(samples.folded.filter(F.col("fold_id") == m.key.fold_id)).select("ind_id", "probability").collect()
        for r in rows:
            want[r["ind_id"]] = want.get(r["ind_id"], 0) + r["probability"][1] / 10
    got = pu.fit_predict_cv(features, folds, bags, stages(), 1.0, params, None, forest(), parallelism=3, nodes=bound).collect()
    assert {r["ind_id"]: round(r["score"], 9) for r in got} == {i: round(v, 9) for i, v in want.items()}
    assert len(got) == features.count()


def test_slices_of_a_forest():
    key = training.ModelKey(1, 1, 1, "Fold1", ())
    deep = RandomForestClassifier(numTrees=7, maxDepth=20)
    assert [s.trees for s in training.tree_slices(key, deep, 100, 2 * 199)] == [2, 2, 2, 1]
    assert [s.trees for s in training.tree_slices(key, deep, 100, 10)] == [1] * 7
    assert [s.trees for s in training.tree_slices(key, RandomForestClassifier(numTrees=7, maxDepth=3), 10**9, 15 * 7)] == [7]
    assert [s.trees for s in training.tree_slices(key, deep.copy().setMinInstancesPerNode(50), 100, 6)] == [2, 2, 2, 1]
    assert [s.trees for s in training.tree_slices(key, deep, 0, 100)] == [7]


def test_fits_go_on_while_a_chunk_is_scored(spark, monkeypatch):
    begun = []

    class Fake:
        def __init__(self, stages):
            pass

        def fit(self, sample):
            begun.append(1)
            return SimpleNamespace(stages=[SimpleNamespace(totalNumNodes=1)])

    monkeypatch.setattr(training, "Pipeline", Fake)
    rows = spark.createDataFrame([(1, 1, f"Fold{i}") for i in range(8)], "common_seed int, bag int, fold_id string")
    keys = [training.ModelKey(1, 1, 1, f"Fold{i}", ()) for i in range(8)]
    chunks = training.fit_models(rows, keys, [], RandomForestClassifier(), parallelism=2)
    first = next(chunks)
    time.sleep(1)
    assert len(begun) >= 4  # two at a time, and the next two while the first chunk is out
    assert len(first) + sum(map(len, chunks)) == 8
