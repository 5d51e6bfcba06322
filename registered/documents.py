"""Queries on documents as a positive/unlabeled table: folds, bags, samples, grids, forests."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import puspark as pu
from puspark.sources import document_features, materialise, read_table

SEEDS = (11, 12)
FOLDS = 3
BAGS = 2
RATIO = 1.5
CONFIGS = 5
#: Names are hashed into so many bins: a forest takes any number of sources.
NAME_BINS = 64
NUMBERS = ["n_chars", "n_words", "n_lines", "mean_word_len", "distinct_share", "digit_share"]


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """(ind_id, source, known_pos) of the documents that are not verified negatives."""
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("ind_id"), "source")
    labels = read_table(spark, folder, "labels").select(F.col("doc_id").alias("ind_id"), "quality")
    return (
        docs.join(labels, "ind_id", "left")
        .filter(F.coalesce(F.col("quality"), F.lit(1)) != 0)
        .select("ind_id", "source", F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("known_pos"))
    )


def _stratified(spark, folder):
    docs = labelled(spark, folder)
    return docs, pu.assign_folds(docs, FOLDS, SEEDS, strata="known_pos")


def fold_assign(spark, folder):
    return pu.assign_folds(labelled(spark, folder), FOLDS, SEEDS)


def fold_assign_stratified(spark, folder):
    return _stratified(spark, folder)[1]


def fold_assign_grouped(spark, folder):
    return pu.assign_folds(labelled(spark, folder), FOLDS, SEEDS, group="source")


def fold_assign_group_strata(spark, folder):
    """Sources whole, folds even in rows and in positives."""
    return pu.balanced_group_folds(labelled(spark, folder), FOLDS, SEEDS, "source", "known_pos")


def fold_assign_numeric_strata(spark, folder):
    """Folds that are even in every quarter of the documents by length."""
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("ind_id"), "n_chars")
    return pu.assign_folds(pu.numeric_strata(docs, "n_chars"), FOLDS, SEEDS, strata="stratum")


def encoded_features(spark, folder):
    """Sources as the share of positives that all other folds have of them."""
    docs, folds = _stratified(spark, folder)
    folded = materialise(pu.with_folds(docs, folds))
    encoded = pu.with_target_rates(folded, ["source"], "known_pos")
    return encoded.select("common_seed", "fold_id", "ind_id", F.round("source_rate", 9).alias("source_rate"))


def grid_data_bounds(spark, folder):
    """Configs whose ranges end at the number of features and at a tenth of the smallest class."""
    ranges = pu.data_ranges(labelled(spark, folder).withColumns({c: F.lit(0) for c in NUMBERS}), "known_pos", NUMBERS)
    return pu.latin_hypercube(spark, ranges, 5, SEEDS)


def fold_sizes_analysis_assessment(spark, folder):
    """Rows and positives on either side of every split; an analysis set is the seed's total less its own fold."""
    docs, folds = _stratified(spark, folder)
    own = pu.with_folds(docs, folds).groupBy("common_seed", "fold_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("known_pos").alias("n_pos")
    )
    seed = Window.partitionBy("common_seed")
    sides = F.array(
        F.struct(F.lit("assessment").alias("part"), F.col("n_rows"), F.col("n_pos")),
        F.struct(
            F.lit("analysis").alias("part"),
            (F.sum("n_rows").over(seed) - F.col("n_rows")).alias("n_rows"),
            (F.sum("n_pos").over(seed) - F.col("n_pos")).alias("n_pos"),
        ),
    )
    return own.withColumn("_sides", sides).select("common_seed", "fold_id", F.inline("_sides"))


def _fold_counts(spark, folder) -> DataFrame:
    docs, folds = _stratified(spark, folder)
    return pu.with_folds(docs, folds).groupBy("common_seed", "fold_id").agg(F.count(F.lit(1)).alias("n_assessed"))


def bag_table(spark, folder):
    """Every (bag, fold) to be fitted, with the number of rows it will score."""
    return pu.make_bags(spark, SEEDS, BAGS).join(_fold_counts(spark, folder), "common_seed")


def downsample_bag(spark, folder):
    return pu.downsample(labelled(spark, folder), "known_pos", RATIO, 5).select("ind_id", "known_pos")


def downsample_all_bags(spark, folder):
    docs, folds = _stratified(spark, folder)
    folded = materialise(pu.with_folds(docs, folds))
    sample = pu.downsample_bags(folded, pu.make_bags(spark, SEEDS, BAGS), "known_pos", RATIO)
    return sample.select("common_seed", "bag", "fold_id", "ind_id", "known_pos")


def grid_explicit(spark, folder):
    """A caller's grid for every seed, with the assessed rows per fold."""
    grid = spark.range(1, 4).select(F.col("id").cast("int").alias("config"), (F.col("id") * 10).cast("int").alias("num_trees"))
    return pu.explicit_grid(pu.make_bags(spark, SEEDS, BAGS), grid).join(_fold_counts(spark, folder), "common_seed")


def grid_latin_hypercube(spark, folder):
    """Space-filling configs per seed whose ``min_instances`` range ends at a tenth of the smallest class."""
    docs = labelled(spark, folder)
    smallest = docs.groupBy("known_pos").count().agg(F.min("count").alias("n")).first()["n"]
    ranges = {"min_instances": (1, max(2, smallest // 10)), "subsampling_rate": (0.5, 1.0)}
    grid = pu.latin_hypercube(spark, ranges, 5, SEEDS)
    return grid.withColumn("subsampling_rate", F.round("subsampling_rate", 9))


def grid_maximin(spark, folder):
    """How often every value of every parameter is in a design of mixed types whose bounds depend on the data."""
    rows = pu.data_ranges(labelled(spark, folder), "known_pos", ["source"])["min_instances_per_node"]
    space = {
        "min_instances": pu.Scale("whole", *rows),
        "rate": pu.Scale("real", 0.5, 1.0),
        "info_gain": pu.Scale("log", 0.0001, 0.1),
        "impurity": pu.Scale("choice", values=(0.0, 1.0)),
    }
    grid = pu.maximin_grid(spark, space, 6, SEEDS)
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("parameter"), F.round(F.col(c).cast("double"), 9).alias("value")) for c in space]))
    return grid.select("common_seed", each).groupBy("common_seed", "parameter", "value").agg(F.count(F.lit(1)).alias("n"))


# --- forests ---------------------------------------------------------------------------------------------------


def with_name_bins(features: DataFrame) -> DataFrame:
    bins = {f"{name}_bin": F.pmod(F.xxhash64(name), F.lit(NAME_BINS)).cast("double") for name in ("lang", "source")}
    return features.withColumns(bins)


def _features(spark, folder):
    """(training table, holdout of verified negatives), measured once."""
    features = materialise(with_name_bins(document_features(spark, folder)))
    return features.filter("known_neg = 0"), features.filter("known_neg = 1")


def stages():
    return [VectorAssembler(inputCols=[*NUMBERS, "lang_bin", "source_bin"], outputCol="features")]


def _forest():
    return RandomForestClassifier(labelCol="known_pos", maxBins=NAME_BINS)


def _tuned(spark, folder):
    features, _ = _features(spark, folder)
    folds = materialise(pu.assign_folds(features, FOLDS, SEEDS, strata="known_pos"))
    grid = pu.latin_hypercube(spark, {"num_trees": (2, 6), "max_depth": (2, 6)}, CONFIGS, SEEDS)
    bags = pu.make_bags(spark, SEEDS, BAGS)
    return pu.tune_cv(features, folds, bags, grid, stages(), RATIO, _forest(), parallelism=6)


def _predicted(spark, folder, with_holdout: bool):
    features, holdout = _features(spark, folder)
    folds = materialise(pu.assign_folds(features, FOLDS, SEEDS, strata="known_pos"))
    bags = pu.make_bags(spark, SEEDS, BAGS)
    params = {"num_trees": 8, "max_depth": 4}
    return pu.fit_predict_cv(
        features, folds, bags, stages(), RATIO, params, holdout if with_holdout else None, _forest(), parallelism=6
    )


def _in_range():
    return F.coalesce(F.col("score").between(0, 1), F.lit(False)).cast("int")


def _coverage(preds: DataFrame, *keys: str) -> DataFrame:
    """Rows and entities each model scored, and whether all scores are probabilities."""
    return preds.groupBy("common_seed", "bag", "fold_id", *keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("ind_id").alias("n_entities"),
        F.sum("known_pos").alias("n_pos"),
        F.min(_in_range()).alias("in_range"),
    )


def split_rows(spark, folder):
    """Both sides of one split, row by row."""
    docs, folds = _stratified(spark, folder)
    sides = zip(("analysis", "assessment"), pu.split(docs, folds, SEEDS[0], "Fold2"))
    analysis, assessment = (rows.select("ind_id", "known_pos", F.lit(name).alias("part")) for name, rows in sides)
    return analysis.unionByName(assessment)


REPEATS = 2
SHARE = 0.75
SAMPLES = 3


def split_repeated_rows(spark, folder):
    """Both parts of all splits of repeated folds, row by row."""
    return pu.repeated_folds(labelled(spark, folder), FOLDS, REPEATS, SEEDS[:1], strata="known_pos").drop("times")


def split_monte_carlo_rows(spark, folder):
    return pu.monte_carlo_splits(labelled(spark, folder), SHARE, SAMPLES, SEEDS, strata="known_pos").drop("times")


def bootstrap_rows(spark, folder):
    """How often every row is in every bootstrap sample, and the rows that are in none."""
    return pu.bootstrap_splits(labelled(spark, folder), SAMPLES, SEEDS, strata="known_pos")


def downsample_bootstrap(spark, folder):
    """The training sample of every bag and bootstrap sample: how many copies of every row are kept."""
    docs = labelled(spark, folder)
    splits = materialise(pu.bootstrap_splits(docs, SAMPLES, SEEDS, strata="known_pos"))
    sample = pu.downsample_sets(pu.members(docs, splits, "analysis"), pu.make_bags(spark, SEEDS, BAGS), "known_pos", RATIO)
    return sample.groupBy("common_seed", "bag", "fold_id", "ind_id", "known_pos").agg(F.count(F.lit(1)).alias("copies"))


def tune_cv_repeated(spark, folder):
    """What each model of overlapping splits scored, with its config."""
    features, _ = _features(spark, folder)
    splits = materialise(pu.repeated_folds(features, FOLDS, REPEATS, SEEDS[:1], strata="known_pos"))
    grid = spark.createDataFrame([(1, 3, 3)], "config int, num_trees int, max_depth int")
    bags = pu.make_bags(spark, SEEDS[:1], 1)
    return _coverage(pu.tune_cv(features, splits, bags, grid, stages(), RATIO, _forest(), parallelism=6), "config")


def tune_cv_scores(spark, folder):
    """Every scored row with its model's key and label, and whether its score is a probability."""
    tuned = _tuned(spark, folder)
    return tuned.select("common_seed", "bag", "counter", "fold_id", "config", "ind_id", "known_pos", _in_range().alias("in_range"))


def tune_cv_coverage(spark, folder):
    return _coverage(_tuned(spark, folder), "config")


def _scored_rows(preds: DataFrame) -> DataFrame:
    return preds.select(
        "common_seed", "bag", "counter", "fold_id", "holdout", "ind_id", "known_pos", "known_neg", _in_range().alias("in_range")
    )


def train_predict_assess(spark, folder):
    return _scored_rows(_predicted(spark, folder, False))


def train_predict_holdout(spark, folder):
    return _scored_rows(_predicted(spark, folder, True))


def train_predict_coverage(spark, folder):
    return _coverage(_predicted(spark, folder, True), "holdout")


def documents_classified(spark, folder):
    """Documents end to end - forests, mean score, prior, threshold, class, confidence - as facts that must hold."""
    result = pu.classify_pu(_predicted(spark, folder, True))
    above = (F.col("score_mean") > result.threshold.threshold).cast("int")
    known = F.col("conf_status").isin("fitted", "constant")
    fair = F.when(known, F.col("confidence").between(0, 1)).otherwise(F.col("confidence").isNull())
    return result.scored.select(
        "ind_id",
        "holdout",
        "known_pos",
        "known_neg",
        F.col("score_mean").between(0, 1).cast("int").alias("mean_ok"),
        (F.col("pred_class") == above).cast("int").alias("class_ok"),
        F.coalesce(fair, F.lit(False)).cast("int").alias("confidence_ok"),
        F.lit(int(0 <= result.alpha <= 1)).alias("alpha_ok"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        fold_assign,
        fold_assign_stratified,
        fold_assign_grouped,
        fold_assign_group_strata,
        fold_assign_numeric_strata,
        encoded_features,
        fold_sizes_analysis_assessment,
        split_rows,
        split_repeated_rows,
        split_monte_carlo_rows,
        bootstrap_rows,
        downsample_bootstrap,
        bag_table,
        downsample_bag,
        downsample_all_bags,
        grid_explicit,
        grid_latin_hypercube,
        grid_data_bounds,
        grid_maximin,
        tune_cv_scores,
        tune_cv_coverage,
        tune_cv_repeated,
        train_predict_assess,
        train_predict_holdout,
        train_predict_coverage,
        documents_classified,
    )
}
