"""Prefix trie of conversations by time-forward processing.

Every conversation is a row of turns; each distinct row of first turns is a node. A node's id is the xor of hashes of
its (place, turn), so ids of all prefixes are running aggregates that run over ranges of turns: a conversation of any
length is spread over tasks. Ids have 128 bits.

Totals of subtrees go from nodes to parents in reverse level order. Levels are cut into bands, and the part of a
subtree that lies in a band is a shard. From the deepest band up, a task sorts the nodes of its shards by level,
deepest first, and hands each node's totals to its parent through a priority queue that spills; what the shards' roots
hold is then added up per parent, combined before the shuffle, and enters the next band. A band with a shard of too many
nodes is cut in two, down to single levels, so that no task holds more than a bounded shard. Nodes of one conversation
alone need no processing: their subtree is a path with one leaf and nothing saved; all such paths below a node enter it
as one number.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.operators.joins import HOT_ROWS, skewed_join
from puspark.operators.scan import Scan, two_level_scan
from puspark.sources.shared import materialise

#: Turns that a conversation may take over from the first of its hundred.
SHARED_TURNS = 6
#: Levels of the bands that totals are passed up in, before crowded ones are cut.
BANDS = (4, 16, 64, 256)
#: Nodes of a shard.
SHARD_NODES = 1 << 19
#: Messages that a priority queue holds in memory.
QUEUE_ROWS = 1 << 17
#: Ids of conversations that are spelled in one piece for the digest of a node.
PIECE_IDS = 1 << 13

NODE = ("x", "y")
_NODE = "struct<x: long, y: long>"


def _root() -> Column:
    """The xor of no turns."""
    return F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, chars): turns with their place from 1, by turn (null first), then by role and text's hash.

    Ranges of turns are numbered by themselves and shifted by the turns of the conversation in earlier ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        # the length of the role tells where the text begins
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_hash"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("turn_hash"), F.col("tie")]
    parts = materialise(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    places = two_level_scan(parts, [Scan("pos", F.lit(1), "sum")], ["turn", "turn_hash", "tie"], "part", ["conv_id"])
    return places.select("conv_id", "part", F.col("pos").cast("long").alias("pos"), "turn_hash", "chars")


def shared_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(SHARED_TURNS))


def rebuilt(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, depth, turn_hash, chars, last) of the rebuilt conversations, and (conv_id, length) of them.

    The first turns come from conversation c - c % 100, all others from the conversation itself.
    """
    own = F.col("conv_id")
    counts = materialise(places.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("part").alias("parts")))
    first = places.filter((own % 100 == 0) & (F.col("pos") < SHARED_TURNS))
    heads = first.groupBy(own.alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_hash", "chars"))).alias("head"))
    convs = counts.withColumn("base", own - own % 100).join(heads, "base", "left").withColumn("shared", shared_turns(own))
    head = F.coalesce(F.slice("head", 1, F.col("shared").cast("int")), F.array().cast(heads.schema["head"].dataType))
    convs = convs.select("conv_id", "n", "shared", head.alias("head"))
    convs = materialise(convs.withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))))
    kept = skewed_join(places.filter(F.col("pos") > shared_turns(own)), convs.drop("shared"), "conv_id")
    depth = F.col("pos") - shared_turns(own) + F.size("head")
    kept = kept.select("conv_id", "part", depth.alias("depth"), "turn_hash", "chars", "length")
    taken = convs.select("conv_id", F.lit(-1).alias("part"), "length", F.inline("head"))
    taken = taken.select("conv_id", "part", F.col("pos").alias("depth"), "turn_hash", "chars", "length")
    turns = kept.unionByName(taken).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return turns, convs.select("conv_id", "length")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, last): the node that every turn leads to; ids are pairs of longs."""
    terms = [F.xxhash64(F.lit(seed), "depth", "turn_hash") for seed in ("x", "y")]
    running = [Scan(name, F.col(f"term_{name}"), "xor") for name in NODE]
    rows = turns.withColumns({f"term_{name}": term for name, term in zip(NODE, terms)}).drop("turn_hash")
    rows = two_level_scan(rows, running, ["depth"], "part", ["conv_id"])
    before = [F.col(name).bitwiseXOR(F.col(f"term_{name}")).alias(name) for name in NODE]
    return rows.select("conv_id", "depth", F.struct(*NODE).alias("node"), F.struct(*before).alias("parent"), "chars", "last")


def nodes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, parent, depth, conv_id, n_convs, chars, n_children, alone) of every node; ``alone``: children of one
    conversation."""
    rows = steps.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.min("parent").alias("parent")
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(F.lit(0).cast("long").alias("depth"), _root().alias("node"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    rows = materialise(rows.unionByName(top, allowMissingColumns=True))
    children = rows.filter("depth > 0").groupBy(F.col("parent").alias("node"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    return materialise(rows.join(children, "node", "left").fillna(0, ["n_children", "alone"]))


class SpillingQueue:
    """A priority queue of tuples that writes sorted runs to the task's scratch when it holds too many, and reads each
    run back in order, one row at a time."""

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.heap, self.runs = rows, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.rows:
            run = tempfile.TemporaryFile()  # the attempt's own, gone with its process
            for one in sorted(self.heap):
                pickle.dump(one, run)
            run.seek(0)
            self.heap = []
            self._next(run)

    def _next(self, run) -> None:
        try:
            # runs are told apart by a number, so that files are never compared
            heapq.heappush(self.runs, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def peek(self) -> tuple | None:
        heads = [h[0] if h is self.heap else h[0][0] for h in (self.heap, self.runs) if h]
        return min(heads) if heads else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, run = heapq.heappop(self.runs)
            self._next(run)
            return item
        return heapq.heappop(self.heap)


def _forward(queue_rows: int):
    """Totals of nodes that come by shard, deepest first: what a node's children sent waits in the queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(queue_rows), None
        for batch in batches:
            columns = [batch.column(c) if c in batch.schema.names else None for c in ("shard", "node", "parent", "depth", "leaves", "saved")]
            shards, ids, parents = [list(zip(*(c.field(i).to_pylist() for i in (0, 1)))) for c in columns[:3]]
            depth, leaves, saved = [c.to_pylist() for c in columns[3:]]
            for i, node in enumerate(ids):
                if shards[i] != shard:
                    # what is left was sent to the parents of earlier shards' roots, which are in no shard of this band
                    queue, shard = SpillingQueue(queue_rows), shards[i]
                key = (-depth[i], node)
                while (head := queue.peek()) is not None and head[:2] <= key:
                    message = queue.pop()
                    if message[:2] == key:
                        leaves[i] += message[2]
                        saved[i] += message[3]
                queue.push((1 - depth[i], parents[i], leaves[i], saved[i]))
            yield pa.RecordBatch.from_arrays([columns[1], columns[2], columns[3], pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], ["node", "parent", "depth", "leaves", "saved"])

    return run


def _shards(band: DataFrame, steps: DataFrame, first: int) -> DataFrame:
    """``band`` with each node's ancestor at level ``first``, from the path of the node's least conversation."""
    tops = steps.filter(F.col("depth") == first).select("conv_id", F.col("node").alias("shard"))
    return band.join(tops, "conv_id")


def totals(tree: DataFrame, steps: DataFrame, bands: Sequence[int] = BANDS, shard_nodes: int = SHARD_NODES, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(node, leaves, saved) of every node of several conversations and of the root."""
    saved = (F.col("n_convs") - 1) * F.col("chars")
    own = F.when(F.col("n_children") == 0, 1).otherwise(F.col("alone")).cast("long")
    several = tree.filter("n_convs > 1 or depth = 0").select("node", "parent", "depth", "conv_id", own.alias("leaves"), saved.alias("saved"))
    several = materialise(several)
    deepest = several.agg(F.max("depth")).first()[0] or 0
    ends = [b for b in bands if b < deepest]
    while ends and 4 * ends[-1] < deepest:
        ends.append(4 * ends[-1])
    waiting = [(a + 1, b) for a, b in zip([0, *ends], [*ends, deepest]) if a < b]
    done: list[DataFrame] = []
    inbox: DataFrame | None = None

    def with_messages(rows: DataFrame) -> DataFrame:
        if inbox is None:
            return rows
        both = rows.join(inbox, "node", "left")
        return both.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")

    while waiting:
        a, b = waiting.pop()
        band = several.filter(F.col("depth").between(a, b))
        if a < b:
            band = materialise(_shards(band, steps, a))
            most = band.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
            if most > shard_nodes:
                waiting += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]
                continue
            band = with_messages(band).select("shard", "node", "parent", "depth", "leaves", "saved").repartition("shard")
            band = band.sortWithinPartitions("shard", F.desc("depth"), "node")
            band = band.mapInArrow(_forward(queue_rows), f"node {_NODE}, parent {_NODE}, depth long, leaves long, saved long")
        else:
            band = with_messages(band).select("node", "parent", "depth", "leaves", "saved")
        done.append(materialise(band))
        roots = done[-1].filter(F.col("depth") == a).groupBy(F.col("parent").alias("node"))
        inbox = materialise(roots.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    result = with_messages(several.filter("depth = 0")).select("node", "leaves", "saved")
    for band in done:
        result = result.unionByName(band.select("node", "leaves", "saved"))
    return result


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of conversations that end at a node, comma-joined in pieces; rows come by node and id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column("node").field(i).to_numpy() for i in (0, 1))
        fresh = np.ones(len(x) + 1, bool)
        fresh[1:-1] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        fresh[:-1:PIECE_IDS] = True
        at, ids = np.flatnonzero(fresh), batch.column("conv_id").to_pylist()
        joined = [",".join(map(str, ids[s:e])) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        starts = pa.array(at[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("node").take(starts), batch.column("conv_id").take(starts), pa.array(joined)], ["node", "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order; no node's list is ever held whole."""
    node, digest = None, None
    for batch in batches:
        found, hashes = [], []
        for own, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
            if own == node:
                digest.update(b"," + piece.encode())
                continue
            if node is not None:
                found.append(node)
                hashes.append(digest.hexdigest())
            node, digest = own, hashlib.sha256(piece.encode())
        yield _digest_batch(found, hashes)
    if node is not None:
        yield _digest_batch([node], [digest.hexdigest()])


def _digest_batch(found: list, hashes: list) -> pa.RecordBatch:
    kind = pa.struct([("x", pa.int64()), ("y", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(found, kind), pa.array(hashes, pa.string())], ["node", "ends_sha256"])


def ends(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end.

    Ranges of (node, id) spell their ids in pieces of thousands; a node's pieces, a row for thousands of ids, then pass
    through one task in order, as the digest is one stream by its definition.
    """
    rows = steps.filter("last").select("node", "conv_id").unionByName(convs.filter("length = 0").select(_root().alias("node"), "conv_id"))
    pieces = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, f"node {_NODE}, first long, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, f"node {_NODE}, ends_sha256 string")


def prefix_trie(turns: DataFrame, bands: Sequence[int] = BANDS, shard_nodes: int = SHARD_NODES, queue_rows: int = QUEUE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first; turns of one number by the MD5 of role and text, so that their order is
    fixed whatever the partitioning; repeated rows are turns of their own. Null roles and texts are empty ones. Rows
    without a conv_id belong to no conversation. The remainder of negative ids has their sign, so they take their first
    turns from the id nearer to zero. An empty table has no node, not even a root. Other columns are not read.
    """
    own, convs = rebuilt(materialise(numbered(turns)))
    steps = materialise(paths(own))
    tree = nodes(steps, convs)
    sums = totals(tree, steps, bands, shard_nodes, queue_rows)
    above = tree.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    placed = skewed_join(tree.filter("depth > 0"), above, "parent", hot_rows=hot_rows).drop("n", "parent")
    placed = placed.unionByName(tree.filter("depth = 0").drop("parent"), allowMissingColumns=True)
    full = placed.join(sums, "node", "left").join(ends(steps, convs), "node", "left")
    return full.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
