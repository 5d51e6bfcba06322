"""From raw documents to a training mix: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents`` and those that a user's table has besides, whatever
their names. Null and empty texts pass the stages that look for something in a text; rows that agree in all columns are
treated alike; each stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puspark.llm import decontaminate, line_dedup, mixing, near_duplicates, quality
from puspark.llm.text import unused
from puspark.sources import materialise, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject: scores of one half or more.

    Null and empty texts are scored as texts without words. Without labels of both classes every score is one half.
    """
    model = quality.fit(quality.measured(docs), read_table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier one has; those of which nothing but white space is left go.

    Null texts and texts without such runs stay as they are. ``n_chars``, where there is one, follows the text.
    """
    user, mark = [c for c in docs.columns if c.lower() == "n_removed"], unused("n_removed_before", docs.columns)
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed({c: mark for c in user}))
    left = kept.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("n_removed")
    left = left.withColumnsRenamed({mark: c for c in user})
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, null ids last, and of rows that repeat both id
    and text one. Documents without words all stay."""
    return near_duplicates.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages; those that go are no use without them.

    Null and empty texts have none. A user's columns called as the scan's results are kept.
    """
    user = [c for c in docs.columns if c.lower() in ("n_words", "spans", "items")]
    marks = {c: unused(f"user_{c}", docs.columns) for c in user}
    found = decontaminate.scan(docs.withColumnsRenamed(marks), read_table(spark, sf_dir, "benchmark"), keep=[marks.get(c, c) for c in docs.columns])
    return found.filter(~decontaminate.is_contaminated()).select(*[F.col(marks.get(c, c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: size, source_size, target and taken. Null texts have no words."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]

#: A discriminant and signatures have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
