"""Input tables and the prediction/feature tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puspark.operators.joins import HOT_ROWS, skewed_join
from puspark.sources.shared import materialise


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_totals(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every line with its order's total quantity ``sq`` and number of lines ``n``."""
    totals = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sq"), F.count(F.lit(1)).alias("n"))
    return skewed_join(lines, materialise(totals), "l_orderkey", hot_rows=hot_rows)


def quantity_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Several scores per order, with labels that follow the order's mean quantity."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = F.col("l_orderkey")
    held = key % 5 == 0
    return with_totals(lines).select(
        key.alias("ind_id"),
        F.col("l_linenumber").alias("bag"),
        (F.col("l_linenumber") % 2).alias("common_seed"),
        ((F.col("l_quantity") + F.lit(0.123456)) / F.lit(51.7)).alias("score"),
        held.cast("int").alias("holdout"),
        (~held & (key % 3 == 0) & (2 * F.col("sq") > 61 * F.col("n"))).cast("int").alias("known_pos"),
        (held & (2 * F.col("sq") <= 45 * F.col("n"))).cast("int").alias("known_neg"),
        "l_quantity",
    )


def tuning_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Tuning-shaped scores for three configs: the score, its mirror image, and a coarse one with many ties."""
    preds = quantity_predictions(spark, folder).filter("holdout = 0")
    configs = F.array(
        F.struct(F.lit(1).alias("config"), F.col("score").alias("score")),
        F.struct(F.lit(2).alias("config"), (1 - F.col("score")).alias("score")),
        F.struct(F.lit(3).alias("config"), (F.floor(F.col("l_quantity") / 10) / F.lit(5.0)).alias("score")),
    )
    return preds.select(
        "common_seed",
        "bag",
        F.col("bag").alias("counter"),
        F.concat(F.lit("Fold"), F.col("ind_id") % 4 + 1).alias("fold_id"),
        "ind_id",
        "known_pos",
        F.inline(configs),
    )


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a positive/unlabeled table: labelled good = positive, labelled bad = verified negative."""
    docs = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    words = F.split(F.trim("text"), r"\s+")
    measured = docs.select(
        F.col("doc_id").alias("ind_id"),
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        F.size(F.array_distinct(words)).cast("double").alias("n_distinct"),
        F.length(F.concat_ws("", words)).cast("double").alias("n_letters"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).cast("double").alias("n_digits"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("double").alias("n_lines"),
    )
    at_least_one = F.greatest(F.col("n_words"), F.lit(1.0))
    return (
        measured.join(labels.withColumnRenamed("doc_id", "ind_id"), "ind_id", "left")
        .withColumns(
            {
                "known_pos": F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)),
                "known_neg": F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)),
                "mean_word_len": F.col("n_letters") / at_least_one,
                "distinct_share": F.col("n_distinct") / at_least_one,
                "digit_share": F.col("n_digits") / F.greatest(F.col("n_chars"), F.lit(1.0)),
            }
        )
        .drop("quality", "n_distinct", "n_letters", "n_digits")
    )
