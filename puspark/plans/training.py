"""Cross-validated random-forest ensembles: one forest per (seed, bag, fold, config), every row scored out of fold.

The feature table is joined with its folds once and written partitioned by fold; all training samples are drawn in
one pass and written partitioned by model, so a fit reads its own sample only. Forests are fitted a few at a time, large
ones in slices of trees, whose votes are added up; their scores are written and they are let go. What a task holds of
them is bounded by a number of tree nodes that is known before they are fitted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puspark.operators.checks import require_columns, require_unique
from puspark.operators.sampling import downsample_bags, explicit_grid, require_partition, with_folds
from puspark.operators.splits import is_split_table, require_disjoint, split_samples
from puspark.sources.shared import materialise, table_path

#: Tree nodes of the forests that score rows side by side: some 90 bytes of a task's binary each.
NODES_PER_SCAN = 250_000
#: Fits that run, and fits that wait for their place: so many times ``parallelism`` together.
AHEAD = 2
#: Between the seeds of a forest's slices.
SEED_STEP = 1_000_003
NOT_PARAMETERS = ("common_seed", "config")


class ModelKey(NamedTuple):
    common_seed: int
    bag: int
    counter: int
    fold_id: str
    params: tuple[tuple[str, object], ...]


class Fitted(NamedTuple):
    """A forest, or ``trees`` of its ``all_trees``."""

    key: ModelKey
    model: PipelineModel
    trees: int = 1
    all_trees: int = 1

    @property
    def nodes(self) -> int:
        return self.model.stages[-1].totalNumNodes


class Slice(NamedTuple):
    """Trees to fit: the ``number``-th slice of a forest."""

    key: ModelKey
    number: int
    trees: int
    all_trees: int


class Samples(NamedTuple):
    folded: DataFrame
    training: DataFrame


def draw_samples(
    features: DataFrame, folds: DataFrame, bags: DataFrame, ratio: float, label: str = "known_pos", key: str = "ind_id"
) -> Samples:
    """The rows every split assesses and the training sample of every model, both written.

    ``folds`` is a table of folds, which are trained on all others of their seed, or a split table, whose sets may overlap.
    """
    require_columns(features, [key, label])
    require_columns(folds, ["common_seed", "fold_id", key])
    require_columns(bags, ["common_seed", "bag", "recipe_seed", "counter"])
    require_unique(features, key)
    fold = ["common_seed", "fold_id"]
    model = ["common_seed", "bag", "fold_id"]
    # rebalancing groups rows by directory and still splits a large one over several tasks
    if is_split_table(folds):
        require_disjoint(features, folds, key)
        assessed, training = split_samples(features, folds, bags, label, ratio, key)
        return Samples(materialise(assessed.hint("rebalance", *fold), fold), materialise(training.hint("rebalance", *model), model))
    require_partition(features, folds, key)
    folded = materialise(with_folds(features, folds, key).hint("rebalance", *fold), fold)
    training = downsample_bags(folded, bags, label, ratio, key)
    return Samples(folded, materialise(training.hint("rebalance", *model), model))


def model_keys(folds: DataFrame, bags: DataFrame, grid: DataFrame | None = None) -> list[ModelKey]:
    """One key per forest to be fitted; a short list by nature, as each entry is a separate fit."""
    names = folds.select("common_seed", "fold_id").distinct()
    wanted = bags.select("common_seed", "bag", "counter").join(names, "common_seed")
    params: list[str] = []
    if grid is not None:
        grid = explicit_grid(bags, grid)
        params = [c for c in grid.columns if c != "common_seed"]
        wanted = wanted.join(grid, "common_seed")
    rows = wanted.orderBy("common_seed", "bag", "fold_id", *params).collect()
    return [
        ModelKey(r["common_seed"], r["bag"], r["counter"], r["fold_id"], tuple((p, r[p]) for p in params)) for r in rows
    ]


def _configured(forest: RandomForestClassifier, key: ModelKey, fixed: Mapping[str, object], rows: int = 0) -> RandomForestClassifier:
    """The forest with this model's parameters; ``min_instances_per_node`` sets ``minInstancesPerNode`` and so on.

    Two depend on the data: ``features_per_split``, a number of features or a share of them, and ``min_rows_share``, the
    least part of the sample's ``rows`` in a leaf.
    """
    values = {**fixed, **{name: value for name, value in key.params if name not in NOT_PARAMETERS}}
    settings = {forest.getParam("seed"): int(key.common_seed)}
    if (number := values.pop("features_per_split", None)) is not None:
        settings[forest.featureSubsetStrategy] = str(number)
    if (share := values.pop("min_rows_share", None)) is not None:
        settings[forest.minInstancesPerNode] = max(1, math.ceil(share * rows))
    for name, value in values.items():
        head, *rest = name.split("_")
        settings[forest.getParam(head + "".join(w.capitalize() for w in rest))] = value
    return forest.copy(settings)


def tree_slices(key: ModelKey, forest: RandomForestClassifier, rows: int, nodes: int) -> list[Slice]:
    """The trees of a forest in slices of at most ``nodes`` nodes; one tree is the least slice.

    A tree of depth d has less than 2^(d+1) nodes, and less than twice as many as its leaves can have rows.
    """
    leaves = max(1, rows // max(1, forest.getMinInstancesPerNode()))
    most = min(2 ** (forest.getMaxDepth() + 1) - 1, 2 * leaves - 1)
    own, all_trees = max(1, nodes // most), forest.getNumTrees()
    return [Slice(key, i, min(own, all_trees - start), all_trees) for i, start in enumerate(range(0, all_trees, own))]


def fit_models(
    training: DataFrame,
    keys: Sequence[ModelKey],
    stages: Sequence[Estimator],
    forest: RandomForestClassifier,
    fixed: Mapping[str, object] | None = None,
    parallelism: int = 4,
    nodes: int = NODES_PER_SCAN,
) -> Iterator[list[Fitted]]:
    """Fit one pipeline per key, in slices of at most ``nodes`` tree nodes; chunks hold slices of one split.

    Driver threads only submit the jobs, ``parallelism`` at a time, and the next one as soon as one is done, also while
    the caller is busy with a chunk: as many as run wait for a thread. The fits themselves run on the executors. A chunk is handed out once slices with ``nodes`` nodes wait, or all of its split
    are done, and is not held here then. The first slice is drawn by the model's seed, further ones by their own.
    """
    model = ["common_seed", "bag", "fold_id"]
    sizes = {tuple(r[c] for c in model): r["count"] for r in training.groupBy(*model).count().collect()}
    slices: list[Slice] = []
    for key in sorted(keys, key=lambda k: (k.common_seed, k.fold_id)):
        rows = sizes.get((key.common_seed, key.bag, key.fold_id), 0)
        slices += tree_slices(key, _configured(forest, key, fixed or {}, rows), rows, nodes)

    def fit(part: Slice) -> Fitted:
        key = part.key
        sample = training.filter(
            (F.col("common_seed") == key.common_seed) & (F.col("bag") == key.bag) & (F.col("fold_id") == key.fold_id)
        )
        rows = sizes.get((key.common_seed, key.bag, key.fold_id), 0)
        trees = _configured(forest, key, fixed or {}, rows).setNumTrees(part.trees)
        steps = [stage.copy() for stage in stages] + [trees.setSeed(trees.getSeed() + SEED_STEP * part.number)]
        return Fitted(key, Pipeline(stages=steps).fit(sample), part.trees, part.all_trees)

    def split_of(key: ModelKey) -> tuple[int, str]:
        return key.common_seed, key.fold_id

    left = Counter(split_of(part.key) for part in slices)
    held: dict[tuple[int, str], list[Fitted]] = {}
    wrapped = inheritable_thread_target(training.sparkSession)(fit)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        running: set[Future[Fitted]] = set()
        try:
            while slices or running:
                while slices and len(running) < AHEAD * parallelism:
                    running.add(pool.submit(wrapped, slices.pop(0)))
                done, running = wait(running, return_when=FIRST_COMPLETED)
                while done:
                    one = done.pop().result()
                    held.setdefault(split_of(one.key), []).append(one)
                    left[split_of(one.key)] -= 1
                    del one
                ready = [name for name in held if not left[name]]
                if not ready and sum(m.nodes for own in held.values() for m in own) >= nodes:
                    ready = [max(held, key=lambda name: sum(m.nodes for m in held[name]))]
                for name in ready:
                    yield held.pop(name)
        finally:
            for future in running:
                future.cancel()


def score_rows(rows: DataFrame, models: Sequence[Fitted], keep: Sequence[str]) -> DataFrame:
    """Each of ``rows`` scored by each of ``models``, in one scan: (model key, kept columns, score).

    Slices of one forest give one row: the sum of their votes over the number of all its trees.
    """
    wide = rows
    base = rows.columns
    votes: dict[ModelKey, list[str]] = {}
    for i, fitted in enumerate(models):
        probability = fitted.model.stages[-1].getProbabilityCol()
        before = [name for names in votes.values() for name in names]
        share = F.get(vector_to_array(probability), F.lit(1))
        if fitted.trees != fitted.all_trees:
            share = share * F.lit(fitted.trees / fitted.all_trees)
        wide = fitted.model.transform(wide).select(*base, *before, share.alias(f"_votes{i}"))
        votes.setdefault(fitted.key, []).append(f"_votes{i}")
    each = [
        F.struct(
            F.lit(key.common_seed).alias("common_seed"),
            F.lit(key.bag).alias("bag"),
            F.lit(key.counter).alias("counter"),
            F.lit(key.fold_id).alias("fold_id"),
            *[F.lit(value).alias(name) for name, value in key.params],
            reduce(add, [F.col(name) for name in names]).alias("score"),
        )
        for key, names in votes.items()
    ]
    return wide.select(*keep, F.inline(F.array(*each)))


def score_assessment(folded: DataFrame, models: Sequence[Fitted], keep: Sequence[str]) -> DataFrame:
    """The rows of the models' fold, which their training left out; reads that fold's directory only."""
    key = models[0].key
    own = (F.col("common_seed") == key.common_seed) & (F.col("fold_id") == key.fold_id)
    return score_rows(folded.filter(own).drop("common_seed", "fold_id"), models, keep)


def score_holdout(holdout: DataFrame, models: Sequence[Fitted], keep: Sequence[str]) -> DataFrame:
    """Every holdout row scored by every model."""
    return score_rows(holdout, models, keep)


def _written(
    spark: SparkSession, chunks: Iterator[list[Fitted]], scored: Callable[[list[Fitted]], Sequence[DataFrame]]
) -> DataFrame:
    """The scores of all chunks in one table; each chunk is scored, written and let go.

    Votes of forests that are in several chunks are written beside it and added up at the end.
    """
    whole, parts, schema, sliced = table_path(spark), table_path(spark), None, False
    for models in chunks:
        trees = Counter()
        for m in models:
            trees[m.key] += m.trees
        complete = [m for m in models if trees[m.key] == m.all_trees]
        partial = [m for m in models if trees[m.key] != m.all_trees]
        for path, own in ((whole, complete), (parts, partial)):
            for part in scored(own) if own else ():
                part.write.mode("append").parquet(path)
                schema = part.schema
        sliced |= bool(partial)
        del models, complete, partial
        m = own = part = None
    if schema is None:
        raise ValueError("there is no model to fit: seeds of folds, bags and grid have none in common")
    spark.createDataFrame([], schema).write.mode("append").parquet(whole)
    table = spark.read.schema(schema).parquet(whole)
    if not sliced:
        return table
    votes = spark.read.schema(schema).parquet(parts)
    added = votes.groupBy(*[c for c in votes.columns if c != "score"]).agg(F.sum("score").alias("score"))
    return table.unionByName(materialise(added))


def tune_cv(
    features: DataFrame,
    folds: DataFrame,
    bags: DataFrame,
    grid: DataFrame,
    stages: Sequence[Estimator],
    ratio: float,
    forest: RandomForestClassifier | None = None,
    label: str = "known_pos",
    key: str = "ind_id",
    parallelism: int = 4,
    nodes: int = NODES_PER_SCAN,
) -> DataFrame:
    """Out-of-fold scores of every config in ``grid``: (seed, bag, counter, fold, parameters, key, label, score)."""
    samples = draw_samples(features, folds, bags, ratio, label, key)
    keys = model_keys(folds, bags, grid)
    forest = forest or RandomForestClassifier(labelCol=label)
    chunks = fit_models(samples.training, keys, stages, forest, parallelism=parallelism, nodes=nodes)
    return _written(features.sparkSession, chunks, lambda models: [score_assessment(samples.folded, models, [key, label])])


def fit_predict_cv(
    features: DataFrame,
    folds: DataFrame,
    bags: DataFrame,
    stages: Sequence[Estimator],
    ratio: float,
    params: Mapping[str, object] | None = None,
    holdout: DataFrame | None = None,
    forest: RandomForestClassifier | None = None,
    label: str = "known_pos",
    negative: str = "known_neg",
    key: str = "ind_id",
    parallelism: int = 4,
    nodes: int = NODES_PER_SCAN,
) -> DataFrame:
    """Scores of one config: every row out of fold (holdout 0), every row of ``holdout`` by every model (holdout 1)."""
    samples = draw_samples(features, folds, bags, ratio, label, key)
    keys = model_keys(folds, bags)
    forest = forest or RandomForestClassifier(labelCol=label)
    keep = [key, label, negative]

    def scored(models: list[Fitted]) -> list[DataFrame]:
        out = [score_assessment(samples.folded, models, keep).withColumn("holdout", F.lit(0))]
        return out if holdout is None else [*out, score_holdout(holdout, models, keep).withColumn("holdout", F.lit(1))]

    chunks = fit_models(samples.training, keys, stages, forest, params, parallelism, nodes)
    return _written(features.sparkSession, chunks, scored)
