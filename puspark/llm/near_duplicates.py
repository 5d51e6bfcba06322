"""MinHash near-duplicates by an LSH forest.

Texts become sets of hashed word shingles; equal sets are one class, and one row per class goes on. Each class has 48
minima, and each of 16 trees sorts all classes by its own rotation of them, so classes that share a long prefix stand
together. A region is a run of rows with one prefix of three minima. Rows of a region whose sketches are alike are
candidates. Candidates are confirmed on full sets, and components are joined.

Two rounds keep the candidates few. The first confirms each row's next neighbour in some trees, which connects groups
of copies by about as many pairs as rows. The second knows the components: rows of a region that have a candidate in
another component meet in one task with their full sets, which hands on a spanning forest of the links it finds. No
round emits all pairs of a group.

Depth adapts to the region. Where many rows of different components share a prefix, as texts with a long passage in
common do, they get a sharper sketch of 256 fresh minima. Where they are too many to compare even these, neighbours meet
first, which joins what is one group of copies; rows that are still as many leave the tree for a deeper one: prefixes of
10 of the fresh minima in 160 orders, then of 20 in 4096. There are as many more orders as a deeper prefix needs for the same recall, and rows of less
similarity meet ever less often, so that the work stays below the square of the rows. What is crowded at the last depth
too is compared whole, block by block.

Chance that all trees miss a pair of similarity s: (1 - s^3)^16, which is 1e-5 at 0.8 and 2e-7 at 0.85; (1 - s^10)^160
and (1 - s^20)^4096 are smaller, also where the pair agrees in two standard deviations fewer of the fresh minima.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.llm.components import connected_components
from puspark.llm.text import NOT_SPACE, Texts, map_batches, mix, slices, unused, word_hashes, words
from puspark.sources.shared import materialise

TREES, PREFIX = 16, 3
MINIMA = TREES * PREFIX
#: Trees whose neighbours the first round confirms.
FIRST_TREES = 2
#: Candidates share at least this part of their minima; pairs of similarity 0.8 fall below it with a chance of 3e-6.
LEAST_SHARED = 0.54
#: Rows of a region that are compared in one task; of larger regions, blocks of half as many meet two by two.
REGION = 1024
#: Rows of regions with more pairs than this of a row outside the largest component with any row get a sharper sketch.
CROWDED = 1 << 18
#: Rows of regions with more pairs than this go to a deeper tree; the same for regions of that tree.
DEEP, DEEP_AGAIN = 1 << 26, 1 << 22
#: Deeper trees: minima of a prefix, and orders.
DEEPER = ((10, 160), (20, 4096))
POOL = 256
#: The part of the fresh minima that candidates of deeper trees share; pairs of 0.8 fall below it with a chance of 1e-6.
LEAST_SHARED_POOL = 0.68
#: Before that, rows that stand this near to each other in these trees meet, so that groups of copies are known as such.
SWEEP, SWEEP_TREES = 256, 4
#: Shingles whose sets meet in one task: candidates of more are dealt over several, two longer ones have their own.
REGION_SHINGLES = 1 << 20
#: Bits of the filter of wanted texts: so many for each, and at most; a full one lets more texts through, none less.
FILTER_BITS, MOST_FILTER_BITS = 32, 1 << 26
LABEL = 4 * PREFIX + MINIMA

_FACTORS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)).tolist()
_POOL_FACTORS = (mix(np.arange(1001, 1001 + POOL, dtype=np.uint64)) | np.uint64(1)).tolist()


def shingle_hashes(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct k-word shingle, by row and hash; texts of fewer words have one for all of them."""
    found = words(texts, NOT_SPACE)
    hashes = word_hashes(texts, found)
    firsts = found.firsts
    n = np.where(found.counts >= k, found.counts - k + 1, np.minimum(found.counts, 1))
    row = np.repeat(np.arange(texts.n), n)
    start = np.arange(len(row)) + np.repeat(firsts[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    size = np.minimum(k, found.counts[row])
    value = size.astype(np.uint64)
    for j in range(k):
        live = j < size
        value[live] = mix(value[live] * np.uint64(0x9E3779B97F4A7C15) + hashes[start[live] + j])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _binary(rows: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """One binary value per row of a byte matrix."""
    n, width = rows.shape
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
    out = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])
    return out if missing is None else pc.if_else(pa.array(~missing), out, pa.scalar(None, pa.binary()))


def _class_ids(size: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Two sums of hashes per set, in order of rows: equal for equal sets."""
    own, some = np.zeros((len(size), 2), np.uint64), np.flatnonzero(size)
    starts = (np.cumsum(size) - size)[some]
    if len(some):
        own[some, 0] = np.add.reduceat(mix(value + np.uint64(1)), starts)
        own[some, 1] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return own.astype(">u8").view(np.uint8).reshape(-1, 16)


def signatures(docs: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with n_shingles, ``class_id`` (16 bytes, equal for equal sets, null for empty ones), minima, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, minima = [np.zeros(0, np.int64)], [np.zeros((0, 16), np.uint8)], [np.zeros((0, MINIMA), np.uint32)]
            for texts in slices(batch.column(len(keep))):
                row, value = shingle_hashes(texts, k)
                size = np.bincount(row, minlength=texts.n)
                some = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[some]
                least = np.zeros((texts.n, MINIMA), np.uint32)
                for j, factor in enumerate(_FACTORS if len(some) else ()):
                    least[some, j] = np.minimum.reduceat((value * np.uint64(factor)) >> np.uint64(32), starts)
                sizes.append(size)
                classes.append(_class_ids(size, value))
                minima.append(least)
            size, least = np.concatenate(sizes), np.concatenate(minima)
            own = _binary(np.concatenate(classes), size == 0)
            wide = _binary(least.astype(">u4").view(np.uint8).reshape(len(least), -1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(size), own, wide, _binary((least & 0xFF).astype(np.uint8))],
                [*keep, "n_shingles", "class_id", "minima", "sketch"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*keep, "text"), run, f"{schema}, n_shingles long, class_id binary, minima binary, sketch binary")


def forest(classes: DataFrame) -> DataFrame:
    """(tree, label, class_id, size): per tree three minima and then a byte of every minimum, in the tree's rotation."""
    width = 4 * PREFIX
    labels = [
        F.struct(
            F.lit(t).alias("tree"),
            F.concat(F.substring("minima", width * t + 1, width), F.substring("sketch", PREFIX * (t + 1) + 1, MINIMA), F.substring("sketch", 1, PREFIX * (t + 1))).alias("label"),
        )
        for t in range(TREES)
    ]
    return classes.select(F.inline(F.array(*labels)), "class_id", "size")


def _bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[len(column)]].reshape(-1, width)


def _region_bounds(tree: np.ndarray, labels: np.ndarray, width: int) -> np.ndarray:
    fresh = np.ones(len(tree) + 1, bool)
    fresh[1:-1] = (tree[1:] != tree[:-1]) | (labels[1:, :width] != labels[:-1, :width]).any(axis=1)
    return np.flatnonzero(fresh)


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 4 * PREFIX :] == b[..., 4 * PREFIX :]).mean(axis=-1)


def _whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A sorted partition in pieces that end between regions."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        bounds = _region_bounds(table["tree"].to_numpy(), _bytes(table["label"], LABEL), 4 * PREFIX)
        cut = int(bounds[-2])
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).combine_chunks()
    if held is not None:
        yield held


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of regions of several rows, each with its next neighbour in the first trees. The rows at either end of the
    partition are kept too: their regions may go on beyond it."""
    pieces = _whole_regions(batches)
    piece, first = next(pieces, None), True
    while piece is not None:
        following = next(pieces, None)
        tree, labels = piece["tree"].to_numpy(), _bytes(piece["label"], LABEL)
        bounds = _region_bounds(tree, labels, 4 * PREFIX)
        keep = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        keep[0] |= first
        keep[-1] |= following is None
        near = np.zeros(len(tree), bool)
        same = np.flatnonzero((tree[1:] == tree[:-1]) & (tree[1:] < FIRST_TREES) & (labels[1:, : 4 * PREFIX] == labels[:-1, : 4 * PREFIX]).all(axis=1))
        near[same] = _similar(labels[same], labels[same + 1]) >= LEAST_SHARED
        ids = piece["class_id"].combine_chunks()
        after = ids.take(pa.array(np.minimum(np.arange(len(tree)) + 1, len(tree) - 1)))
        after = pc.if_else(pa.array(near), after, pa.scalar(None, pa.binary()))
        out = pa.Table.from_arrays([piece["tree"], piece["label"], ids, piece["size"], after], ["tree", "label", "class_id", "size", "next_id"]).filter(pa.array(keep))
        yield from out.combine_chunks().to_batches()
        piece, first = following, False


def _candidates(sketches: np.ndarray, component: np.ndarray, block: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a piece that are candidates and of different components, for some rows at a time; rows of block 1
    do not meet each other, nor do those of block 2, as they have a piece for that."""
    names, code, n = np.unique(component, return_inverse=True, return_counts=True)
    sketch = np.ascontiguousarray(sketches.T)
    minor = np.flatnonzero(code != n.argmax()) if len(names) > 1 else np.zeros(0, np.int64)
    for at in range(0, len(minor), 64):
        own = minor[at : at + 64]
        equal = np.zeros((len(own), len(code)), np.uint16)
        for place in sketch:
            equal += place[own][:, None] == place
        i, j = np.nonzero((equal >= least * len(sketch)) & (code[own][:, None] != code) & ((block[own][:, None] != block) | (block == 0)))
        yield own[i], j


def _across(sketches: np.ndarray, component: np.ndarray, sizes: np.ndarray, block: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Rows of a piece that have a candidate in another component, in one group or several of bounded shingles; both
    rows of every pair of candidates are in one of them, at any size. Pairs are held for some rows at a time only."""
    chosen = np.zeros(len(component), bool)
    for a, b in _candidates(sketches, component, block, least):
        chosen[a] = chosen[b] = True
    use = np.flatnonzero(chosen)
    if sizes[use].sum() <= REGION_SHINGLES:
        if len(use):
            yield use
        return
    dealt, n, held = np.zeros(len(component), np.int64), 0, 0
    for row in use[np.argsort(component[use], kind="stable")].tolist():
        if held and held + sizes[row] > REGION_SHINGLES // 2:
            n, held = n + 1, 0
        dealt[row], held = n, held + sizes[row]
    placed = np.zeros(0, np.int64)
    for a, b in _candidates(sketches, component, block, least):
        both = np.minimum(dealt[a], dealt[b]) * (n + 1) + np.maximum(dealt[a], dealt[b])
        placed = np.unique(np.concatenate((placed, both * len(component) + a, both * len(component) + b)))
    for own in np.split(placed, np.flatnonzero(np.diff(placed // len(component))) + 1):
        yield own % len(component)


def _regions(known: DataFrame) -> DataFrame:
    """(tree, region, main, n_main, n_all) of regions with rows of several components."""
    own, region = ["tree", "region"], F.substring("label", 1, 4 * PREFIX).alias("region")
    parts = known.groupBy("tree", region, "component").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy(*own).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    return parts.filter("n_all > n_main")


def _tasks(known: DataFrame, regions: DataFrame) -> DataFrame:
    """``known`` (tree, label, class_id, size, component) by ``task``: regions, and pairs of blocks of larger regions.

    The rows of a region's main component have blocks of their own, which do not meet each other; so a row has one copy
    for each block of other rows, and these have one for each block of any rows. ``block`` is 0 in tasks of one block.
    """
    region, own = F.substring("label", 1, 4 * PREFIX).alias("region"), ["tree", "region"]
    blocks = lambda n: F.when(F.col("n_all") > REGION, F.ceil(n / (REGION // 2))).cast("int")
    parts = regions.select(*own, F.when(F.col("n_all") > REGION, F.col("main")).alias("main"), blocks(F.col("n_main")).alias("n_main"), blocks(F.col("n_all") - F.col("n_main")).alias("n_rest"))

    def copy(x: Column, y: Column, block: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), block.cast("tinyint").alias("block"))

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    mine = F.pmod(F.xxhash64("class_id", "tree"), F.when(F.col("component") == F.col("main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    rest = F.transform(numbers(F.col("n_rest")), lambda x: copy(F.least(x, "mine"), F.greatest(x, "mine"), F.when(x == F.col("mine"), 0).when(x > F.col("mine"), 1).otherwise(2)))
    main = F.transform(numbers(F.col("n_main")), lambda y: copy(F.col("mine"), F.col("n_rest") + y, F.lit(1)))
    of_main = F.transform(numbers(F.col("n_rest")), lambda x: copy(x, F.col("n_rest") + F.col("mine"), F.lit(2)))
    copies = F.when(F.col("main").isNull(), F.array(copy(F.lit(0), F.lit(0), F.lit(0)))).when(F.col("component") == F.col("main"), of_main).otherwise(F.concat(rest, main))
    rows = known.withColumn("region", region).join(parts, own).withColumn("mine", mine)
    rows = rows.select("tree", "region", "label", "class_id", "size", "component", F.inline(copies))
    return rows.select(F.xxhash64("tree", "region", "x", "y").alias("task"), "label", "class_id", "size", "component", "block")


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A sorted partition in pieces that end between tasks."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        task = table["task"].to_numpy()
        cut = int(np.searchsorted(task, task[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).combine_chunks()
    if held is not None:
        yield held


def _pieces_of(table: pa.Table, first_piece: int, least: float) -> tuple[pa.RecordBatch, int]:
    """Rows to compare in rows sorted by task, by piece, and the number of pieces."""
    width = len(table["label"][0].as_py())
    task, labels, sizes, block = table["task"].to_numpy(), _bytes(table["label"], width), table["size"].to_numpy(), table["block"].to_numpy()
    sketches = labels[:, 4 * PREFIX :]
    component = _bytes(table["component"], 16)[:, :8].copy().view(">u8").ravel()
    bounds = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
    rows, pieces, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s > 1 and (component[s + 1 : e] != component[s]).any():
            for use in _across(sketches[s:e], component[s:e], sizes[s:e], block[s:e], least):
                rows.append(use + s)
                pieces.append(np.full(len(use), first_piece + n))
                n += 1
    at = pa.array(np.concatenate(rows))
    ids = [table[c].combine_chunks().take(at) for c in ("class_id", "component")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(pieces)), *ids], ["piece", "class_id", "component"]), n


def _second_round(least: float):
    """Rows to compare, by piece. Pieces are named by a hash of their rows: those that meet in several trees are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_tasks(batches):
            found, n = _pieces_of(table, 0, least)
            if n:
                size = np.bincount(found.column("piece").to_numpy(), minlength=n)
                ids = _bytes(found.column("class_id"), 16).copy().view(">u8").astype(np.uint64)
                name = mix(np.add.reduceat(mix(ids[:, 0] ^ mix(ids[:, 1] + np.uint64(1))), np.cumsum(size) - size))
                yield found.set_column(0, "piece", pa.array(np.repeat(name, size).view(np.int64)))

    return run


def _compared(percent: int):
    """Links across components in one piece, confirmed on full sets: enough of them to connect what is linked."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, sets = table["class_id"].combine_chunks(), table["shingles"].combine_chunks()
        group = np.unique(_bytes(table["component"], 16).copy().view("V16").ravel(), return_inverse=True)[1].ravel()
        size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        _, term = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(size)), size)
        holders = row[np.argsort(term, kind="stable")]
        ends = np.cumsum(np.bincount(term))
        starts = np.cumsum(size) - size
        a, b = [], []
        main = np.bincount(group).argmax()
        for i in np.flatnonzero(group != main).tolist():
            if group[i] == main:  # others that it is linked with find it
                continue
            own = term[starts[i] : starts[i] + size[i]]
            low = np.where(own > 0, ends[own - 1], 0)
            length = ends[own] - low
            at = np.arange(length.sum()) + np.repeat(low - (np.cumsum(length) - length), length)
            common = np.bincount(holders[at], minlength=len(size))
            linked = np.flatnonzero((100 * common >= percent * (size[i] + size - common)) & (group != group[i]))
            for j in linked[np.unique(group[linked], return_index=True)[1]].tolist():
                a.append(i)
                b.append(j)
                kept, gone = (group[j], group[i]) if group[j] == main else (group[i], group[j])
                group[group == gone] = kept
        return pa.Table.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], ["a", "b"])

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["tree", "label", "class_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _filtered(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` (doc_id, text_key, ...) without most of those that are not in ``wanted`` (i, t, ...), so that few
    others are shuffled: what a broadcast bitmap of hashed keys, of bounded size, has no bit for."""
    n = wanted.count()
    bits = min(MOST_FILTER_BITS, 1 << max(15, (FILTER_BITS * n - 1).bit_length()))

    def place(*key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1

    spots = wanted.select(place("i", "t").alias("_spot"))
    maps = spots.groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    spot = F.bitmap_bit_position("_spot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = byte.bitwiseAND(F.pow(F.lit(2), spot % 8).cast("int")) != 0
    rows = texts.withColumn("_spot", place("doc_id", "text_key")).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    return rows.join(F.broadcast(maps), "_bucket").filter(there).select(*texts.columns)


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(class_id, shingles) of the wanted class ids: sets are made again from one text of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                row, value = shingle_hashes(part, k)
                size = np.bincount(row, minlength=part.n)
                sets = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(value.view(np.int64)))
                same = pc.equal(batch.column(0).slice(part.first, part.n), _binary(_class_ids(size, value)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), sets], ["class_id", "shingles"]).filter(same)

    wanted = wanted.distinct().join(classes.select("class_id", "sample.doc_id", "sample.text_key"), "class_id")
    wanted = materialise(wanted.select("class_id", F.col("doc_id").alias("i"), F.col("text_key").alias("t")))
    texts = _filtered(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), wanted)
    # repeated rows meet where the join has put them: texts are shuffled once
    texts = texts.withColumn("_at", F.xxhash64("doc_id", "text_key"))
    keyed = wanted.withColumn("_to", F.xxhash64("i", "t"))
    # written so that the join goes by one key; with the same text, any row will do
    texts = texts.join(keyed, F.col("_at") == F.col("_to")).filter(F.col("text_key").bitwiseXOR(F.col("t")) == 0)
    texts = texts.groupBy("_at", "class_id").agg(F.any_value("text").alias("text")).select("class_id", "text")
    return materialise(map_batches(texts, run, "class_id binary, shingles array<bigint>"))


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("class_id")), docs, classes, k)
    both = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _linked(known: DataFrame, regions: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, least: float) -> DataFrame:
    """Links across the components of the rows of ``regions``."""
    tasks = _tasks(known, regions).repartition("task").sortWithinPartitions("task")
    pieces = materialise(map_batches(tasks, _second_round(least), "piece long, class_id binary, component binary").distinct())
    sets = _sets(pieces.select("class_id"), docs, classes, k)
    return materialise(pieces.join(sets, "class_id").groupBy("piece").applyInArrow(_compared(percent), "a binary, b binary"))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbours of a sorted partition as pieces, each of one region and of bounded shingles."""
    piece, n, held, last = -1, 0, 0, None
    for batch in batches:
        tree, labels, size = batch.column("tree").to_pylist(), batch.column("label").to_pylist(), batch.column("size").to_pylist()
        pieces = []
        for t, label, shingles in zip(tree, labels, size):
            region = (t, label[: 4 * PREFIX])
            if region != last or n >= SWEEP or held + shingles > REGION_SHINGLES:
                piece, n, held, last = piece + 1, 0, 0, region
            n, held = n + 1, held + shingles
            pieces.append((TaskContext.get().partitionId() << 32) + piece)
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), batch.column("class_id"), batch.column("component")], ["piece", "class_id", "component"])


def _pairs() -> Column:
    """Pairs of a region's row outside its largest component with any row."""
    return (F.col("n_all") - F.col("n_main")) * F.col("n_all")


def _sweep(known: DataFrame, regions: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links among near rows of the most crowded regions; None if there are none. What it misses is found later."""
    regions = regions.filter(_pairs() > DEEP).select("tree", "region")
    if regions.isEmpty():
        return None
    region = F.substring("label", 1, 4 * PREFIX).alias("region")
    rows = known.filter(F.col("tree") < SWEEP_TREES).select("*", region).join(regions, ["tree", "region"], "left_semi").drop("region")
    rows = materialise(rows).repartitionByRange("tree", "label").sortWithinPartitions("tree", "label")
    pieces = materialise(map_batches(rows, _swept, "piece long, class_id binary, component binary"))
    several = pieces.groupBy("piece").agg(F.count_distinct("component").alias("n")).filter("n > 1").select("piece")
    sets = _sets(pieces.select("class_id"), docs, classes, k)
    return materialise(pieces.join(several, "piece", "left_semi").join(sets, "class_id").groupBy("piece").applyInArrow(_compared(percent), "a binary, b binary"))


def _rows_of(known: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of ``known`` that are in ``regions``."""
    region = F.substring("label", 1, 4 * PREFIX).alias("region")
    return known.select("*", region).join(regions.select("tree", "region"), ["tree", "region"], "left_semi").drop("region")


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fresh minima of whole sets."""
    for batch in batches:
        least = np.zeros((batch.num_rows, POOL), np.uint32)
        for i, own in enumerate(batch.column("shingles")):
            value = own.values.to_numpy().view(np.uint64)
            least[i] = [((value * np.uint64(f)) >> np.uint64(32)).min() for f in _POOL_FACTORS]
        pool = _binary(least.astype(">u4").view(np.uint8).reshape(len(least), -1))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("class_id", "size", "component")], pool], ["class_id", "size", "component", "pool"])


def chosen_minima(depth: int, orders: int) -> np.ndarray:
    """For each order ``depth`` of the fresh minima, chosen by a fixed draw."""
    rng = np.random.default_rng(depth)
    return np.stack([rng.choice(POOL, depth, replace=False) for _ in range(orders)])


def _placed(depth: int, orders: int):
    """(label, class_id, size, component): the rows' prefixes in all orders of a deeper tree, hashed to 12 bytes."""
    chosen, names = chosen_minima(depth, orders), ["class_id", "size", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.arange(1, orders + 1, dtype=np.uint64)
        for batch in batches:
            minima = _bytes(batch.column("pool"), 4 * POOL).view(">u4").astype(np.uint64)
            for at in range(0, len(minima), max(1, (1 << 17) // orders)):
                own = minima[at : at + max(1, (1 << 17) // orders)]
                first, second = (np.broadcast_to(mix(start * np.uint64(f)), (len(own), orders)).copy() for f in (3, 5))
                for j in range(depth):
                    first = mix(first ^ own[:, chosen[:, j]])
                    second = second * np.uint64(0x9E3779B97F4A7C15) + own[:, chosen[:, j]]
                name = np.concatenate((first.astype(">u8").reshape(-1, 1).view(np.uint8).reshape(-1, 8), mix(second).astype(">u4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)), axis=1)
                rows = pa.array(np.repeat(np.arange(at, at + len(own)), orders))
                yield pa.RecordBatch.from_arrays([_binary(name), *[batch.column(c).take(rows) for c in names]], ["label", *names])

    return run


def _crowded(known: DataFrame, regions: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across components in crowded ``regions``: by a sharper sketch, those with most pairs by ever deeper trees."""
    rows = materialise(_rows_of(known, regions).select("class_id", "size", "component").distinct())
    sets = _sets(rows.select("class_id"), docs, classes, k)
    pools = materialise(map_batches(rows.join(sets, "class_id"), _pooled, "class_id binary, size long, component binary, pool binary"))
    low = F.expr(f"unhex(array_join(transform(sequence(0, {POOL - 1}), i -> hex(substring(pool, 4 * i + 4, 1))), ''))")
    sketches = materialise(pools.select("class_id", low.alias("sketch")))

    def linked(rows: DataFrame, here: DataFrame) -> DataFrame:
        prefix = F.substring("label", 1, 4 * PREFIX)
        sharp = rows.join(sketches, "class_id").select("tree", F.concat(prefix, "sketch").alias("label"), "class_id", "size", "component")
        return _linked(sharp, here, docs, classes, k, percent, LEAST_SHARED_POOL)

    here = regions.filter(_pairs() <= DEEP)
    links = linked(_rows_of(known, here), here)
    deep = regions.filter(_pairs() > DEEP)
    for n, (depth, orders) in enumerate(DEEPER):
        if deep.isEmpty():
            break
        below = materialise(_rows_of(known, deep).select("class_id").distinct())
        pools = materialise(pools.join(below, "class_id", "left_semi"))
        known = materialise(map_batches(pools, _placed(depth, orders), "label binary, class_id binary, size long, component binary").withColumn("tree", F.lit(n)))
        found = materialise(_regions(known))
        most = DEEP_AGAIN if n + 1 < len(DEEPER) else None  # at the last depth all are compared
        here = found if most is None else found.filter(_pairs() <= most)
        deep = found.filter(F.lit(False)) if most is None else found.filter(_pairs() > most)
        links = links.unionByName(linked(_rows_of(known, here), here))
    return links


def labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, first) of every row; ``first`` marks the rows of a component's least
    (doc_id, text), null ids last. Rows of the same id and text are alike. Empty sets have no ``first``."""
    docs = docs.select("doc_id", "text")
    rows = materialise(signatures(docs.withColumn("text_key", F.xxhash64("text")), k, ("doc_id", "text_key")))
    some = rows.filter("class_id is not null")
    sample = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    classes = some.groupBy("class_id").agg(sample.alias("sample"), F.any_value(F.struct("minima", "sketch", F.col("n_shingles").alias("size"))).alias("m"))
    classes = materialise(classes.select("class_id", "sample", "m.*"))
    dense = materialise(map_batches(_sorted(forest(classes)), _first_round, "tree int, label binary, class_id binary, size long, next_id binary"))
    near = dense.filter("next_id is not null").select(F.least("class_id", "next_id").alias("a"), F.greatest("class_id", "next_id").alias("b")).distinct()
    links = materialise(_confirmed(materialise(near), docs, classes, k, percent))
    grouped = connected_components(links)
    known = dense.select("tree", "label", "class_id", "size").join(grouped.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = materialise(known.withColumn("component", F.coalesce("component", "class_id")))
    regions = materialise(_regions(known))
    swept = _sweep(known, regions, docs, classes, k, percent)
    if swept is not None:
        links = links.unionByName(swept)
        more = connected_components(links).withColumnRenamed("node", "class_id")
        known = known.drop("component").join(more, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        known = materialise(known)
        regions = materialise(_regions(known))
    links = links.unionByName(_linked(known, regions.filter(_pairs() <= CROWDED), docs, classes, k, percent, LEAST_SHARED))
    crowded = regions.filter(_pairs() > CROWDED)
    if not crowded.isEmpty():
        links = links.unionByName(_crowded(known, crowded, docs, classes, k, percent))
    grouped = classes.join(connected_components(links).withColumnRenamed("node", "class_id"), "class_id", "left")
    grouped = materialise(grouped.select("class_id", "sample", F.coalesce("component", "class_id").alias("component")))
    names = grouped.join(grouped.groupBy("component").agg(F.min("sample").alias("name")), "component").select("class_id", "name")
    first = F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("text_key") == F.col("name.text_key"))
    named = some.join(names, "class_id").select("doc_id", "text_key", "n_shingles", F.col("name.doc_id").alias("component_id"), first.alias("first"))
    alone = rows.filter("class_id is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("boolean").alias("first"))
    return named.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles is ``percent`` or more; words
    are runs of characters other than ASCII white space, A-Z in lower case. The component is named by its least id.
    Null and empty texts, and texts without words, have an empty set, are linked with nothing and kept. Rows with a
    null id take part by their text; where no row of a component has an id, its name is null and its rows are kept.
    Repeated rows are rows of one class each. An empty table gives an empty result; other columns are not read.
    """
    rows = labelled(docs, k, percent).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text, any columns) with one row of each component: that of the least id, null ids last, one of
    them if they repeat. All rows without words stay."""
    key, own, names = (unused(n, docs.columns) for n in ("_text_key", "_first_id", "_first_key"))
    first = labelled(docs, k, percent).filter("first").select("doc_id", "text_key").distinct().toDF(own, names)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(worded).withColumn(key, F.xxhash64("text"))
    rows = rows.join(first, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(names)), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).drop(key).unionByName(docs.filter(~worded))
