"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs.

DataFrame functions only. Rows take a pseudo-random key (md5 of seed and id), and each source is read in the order of
its keys. Keys are uniform, so their leading bits cut every source into equal ranges: a window sums within each range,
and the totals of the ranges before it shift the sums. A source with any share of all rows is spread over all ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from puspark.llm.ranks import ranked
from puspark.sources.shared import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17
KEY_BITS = 32


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``totals`` (source, source_size) with ``target``: the sources share ``share`` of all sizes by weight.

    Weights repeat in the order of the sources' code points, null last. No target exceeds ``most`` times its source's
    size; the excess goes to the others by weight. That common level per weight is found by raising it until no
    further source reaches its limit; each round is one aggregate over the sources.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.col("rank") - 1) % len(weights)
    sources = ranked(totals, [F.col("source").asc_nulls_last()])
    sources = materialise(sources.select("source", "source_size", F.get(table, place.cast("int")).alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("limit")))
    whole, weight = sources.agg(F.sum("source_size"), F.sum("w")).first()
    total, level, stopped = share * (whole or 0), 0.0, -1
    level = total / weight if weight else 0.0
    while True:
        full = F.col("limit") <= F.col("w") * level
        n, used, free = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - (used or 0.0)) / free
    return sources.select("source", "source_size", F.least("limit", F.col("w") * level).alias("target"))


def mix(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text) with size, source_size, target and ``taken``, the words the mix takes.

    Whole epochs take every document once each; the rest of a source's budget (its target, rounded) takes documents in
    the order of their keys, the last one up to the word that fills it, so each source's ``taken`` sums to its budget
    exactly. ``copies`` turns the result into texts.

    Null and empty texts have size 0 and take 0; a null source is a source, last in order; null ids and repeated rows
    take part like others (rows with equal id are ordered by size). An empty table gives an empty result. Other
    columns are left out unless ``keep`` names them; names that clash with those added are replaced.
    """
    added = {"source", "size", "source_size", "target", "taken"}
    keep = [c for c in keep if c not in added]
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialise(docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    # as many ranges as rows in each, so that neither ranges nor totals gather in one task
    ranges = max(1, int(rows.count() ** 0.5))
    at = F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = rows.withColumn("cell", F.floor(at * ranges / F.lit(2**KEY_BITS)).cast("int"))
    cells = materialise(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    sources = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    starts = starts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "cell_size")
    starts = starts.withColumnsRenamed({"source": "s", "cell": "c"})
    within = Window.partitionBy("source", "cell").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.floor(budget / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    ordered = (
        rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("rest", budget - epochs * F.col("source_size") - F.col("before"))
    )
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", "rest"))
    return ordered.select(*[F.col(f"k_{c}").alias(c) for c in keep], "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself from a result that kept ``text``: one row per document and epoch, the last text cut to its words."""
    word = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
    whole = F.floor(F.col("taken") / F.nullif(F.col("size"), F.lit(0))).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({word})")), 1, F.col("part")), "")
    epochs = F.array_compact(F.array_append(F.array_repeat(F.lit(-1).cast("int"), F.col("whole")), F.when(F.col("part") > 0, F.col("part"))))
    rows = mixed.filter("taken > 0").withColumns({"whole": whole, "part": part}).withColumn("words", F.explode(epochs))
    return rows.withColumn("text", F.when(F.col("words") < 0, F.col("text")).otherwise(cut)).drop("whole", "part", "words")
