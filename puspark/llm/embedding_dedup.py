"""Embedding near-dedup: a navigable small-world graph per shard, every shard searched with all vectors.

Equal vectors are one class. Classes are dealt to shards by a hash; one task builds a shard's graph and widens the beam
until an audit against brute force passes. Then every block of classes searches every shard: neighbours are confirmed
by cosine in double precision, links are counted per vector, and each task hands on a spanning forest of its links
only. A search whose whole beam is linked does not know how many more there are: such vectors are compared with the
whole shard, a block at a time. No pairs are emitted, and copies of one vector stay one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puspark.llm import hnsw
from puspark.llm.components import connected_components
from puspark.llm.text import mix
from puspark.sources.shared import materialise

LEAST_COSINE = 0.9
#: Shards at least, and classes in one at most (about 60 MB of single-precision vectors of 64 numbers with links).
SHARDS, SHARD_ROWS = 8, 1 << 17
BEAM = 24
#: Vectors that an audit takes at a time, from the shard and from all shards; it goes on until it has seen so many links
#: or so many of the shard's vectors. A beam must find this share of the links.
AUDITED, LEAST_LINKS, MOST_AUDITED, RECALL = 128, 100, 4096, 0.99
#: Single precision may err by this much; what comes near is judged in double precision.
SLACK = 1e-4
BLOCK = 512


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def audited_beam(graph: hnsw.Graph, keys: np.ndarray, cosine: float, outside: np.ndarray, outside_keys: np.ndarray, beam: int = BEAM) -> int:
    """The first width, doubled from ``beam``, at which the audited queries find ``RECALL`` of their links or all their
    beam is linked (then the rest is found by comparing all).

    Queries are the vectors ``outside``, which come from all shards, as most searches do, and rows of the shard, until
    ``LEAST_LINKS`` links are seen. A row's match with itself is no link.
    """
    n, place = len(graph.x), {int(k): i for i, k in enumerate(keys)}
    drawn = np.argsort(mix(keys), kind="stable")[:MOST_AUDITED]
    queries, own, there = [outside], [np.array([place.get(int(k), -1) for k in outside_keys], np.int64)], [np.zeros(0, np.int64)]

    def links(x: np.ndarray, itself: np.ndarray) -> np.ndarray:
        near = x @ graph.x.T >= cosine
        near[np.flatnonzero(itself >= 0), itself[itself >= 0]] = False
        return near.sum(axis=1)

    there.append(links(outside, own[0]))
    for at in range(0, len(drawn), AUDITED):
        rows = drawn[at : at + AUDITED]
        queries.append(graph.x[rows])
        own.append(rows)
        there.append(links(graph.x[rows], rows))
        if sum(t.sum() for t in there) >= LEAST_LINKS:
            break
    x, itself, real = np.concatenate(queries), np.concatenate(own), np.concatenate(there)
    while beam < n:
        found, sims = graph.search(x, beam)
        near = (sims >= cosine) & (found >= 0)
        got = np.where(near.all(axis=1), real, (near & (found != itself[:, None])).sum(axis=1))
        if got.sum() >= RECALL * real.sum():
            break
        beam *= 2
    return min(beam, n)


INDEX = "dim int, shard int, class_id long, n long, vector {vector}, level int, links array<array<int>>, beam int"


def _build(cosine: float, sample: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Index rows of a shard; ``sample`` has some vectors of all shards and their class ids, by length."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("class_id")
        x = _unit(_matrix(table["embedding"])).astype(np.float32)
        keys = table["class_id"].to_numpy().astype(np.uint64)
        level = hnsw.levels(mix(keys + np.uint64(0x9E3779B97F4A7C15)))
        graph = hnsw.build(x, level)
        outside, outside_keys = sample.get(x.shape[1], (x[:0], keys[:0]))
        beam = audited_beam(graph, keys, cosine, outside, outside_keys)
        links: list[list[list[int]]] = [[] for _ in range(len(x))]
        for layer in graph.layers:
            for place, row in enumerate(layer.nodes.tolist()):
                own = layer.links[place]
                links[row].append(layer.nodes[own[own >= 0]].tolist())
        return pa.Table.from_arrays(
            [
                table["dim"], table["shard"], table["class_id"], table["n"], table["embedding"], pa.array([len(k) for k in links], pa.int32()),
                pa.array(links, pa.list_(pa.list_(pa.int32()))), pa.array(np.full(len(x), beam, np.int32)),
            ],
            [c.split()[0] for c in INDEX.split(", ")],
        )

    return run


def _graph(index: pa.Table) -> hnsw.Graph:
    """From the index rows of a shard: ``level`` counts the layers of a row, its links go from the top layer down."""
    x = _unit(_matrix(index["vector"])).astype(np.float32)
    depth, links = index["level"].to_numpy(), index["links"].combine_chunks()
    flat = links.flatten()
    starts = np.cumsum(depth) - depth
    graph = hnsw.Graph(x, [])
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    values = flat.values.to_numpy()
    for height in range(int(depth.max()), 0, -1):
        nodes = np.flatnonzero(depth >= height)
        where = hnsw._places(nodes, len(x))
        own = starts[nodes] + depth[nodes] - height
        sizes = ends[own + 1] - ends[own]
        table = np.full((len(nodes), hnsw.MOST_LINKS), -1, np.int32)
        column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table[np.repeat(np.arange(len(nodes)), sizes), column] = where[values[np.repeat(ends[own], sizes) + column]]
        graph.layers.append(hnsw.Layer(nodes, table))
    return graph


def _links(graph: hnsw.Graph, x: np.ndarray, queries: np.ndarray, beam: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) of the neighbours at ``cosine`` or more, a block of queries at a time."""
    single = queries.astype(np.float32)
    for at in range(0, len(queries), BLOCK):
        found, sims = graph.search(single[at : at + BLOCK], beam)
        near = (sims >= cosine - SLACK) & (found >= 0)
        whole = np.flatnonzero(near.all(axis=1))  # the shard may hold more
        q, c = np.nonzero(near & ~near.all(axis=1)[:, None])
        row = found[q, c]
        if len(whole):
            more, other = np.nonzero(single[at + whole] @ graph.x.T >= cosine - SLACK)
            q, row = np.concatenate((q, whole[more])), np.concatenate((row, other))
        sure = np.einsum("kd,kd->k", queries[at + q], x[row]) >= cosine
        order = np.argsort(q[sure], kind="stable")
        yield at + q[sure][order], row[sure][order]


def _search(cosine: float):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[list, list, list]] = []
        if index.num_rows and queries.num_rows:
            index = index.combine_chunks().sort_by("class_id").combine_chunks()
            graph, x, n = _graph(index), _unit(_matrix(index["vector"])), index["n"].to_numpy()
            ids, own = index["class_id"].to_numpy(), queries["class_id"].to_numpy()
            count = np.zeros(len(own), np.int64)
            group = np.arange(len(ids))  # rows of the shard that links of this task connect
            for q, row in _links(graph, x, _unit(_matrix(queries["embedding"])), index["beam"][0].as_py(), cosine):
                other = ids[row] != own[q]
                q, row = q[other], row[other]
                np.add.at(count, q, n[row])
                for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1) if len(q) else ():
                    groups = np.unique(group[row[part]])
                    out.append((own[q[part[0]]].repeat(len(groups)), np.zeros(len(groups), np.int64), ids[groups]))
                    if len(groups) > 1:
                        group[np.isin(group, groups)] = groups[0]
            some = np.flatnonzero(count)
            out.append((own[some], count[some], own[some]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["class_id", "links", "other"])

    return run


def _audit_sample(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``AUDITED`` vectors of the whole table, drawn by hash, by length: a fixed number, whatever the table."""
    drawn = classes.select("dim", "class_id", "embedding").orderBy(F.xxhash64("class_id", F.lit("audit"))).limit(AUDITED)
    rows: dict[int, list] = {}
    for r in drawn.collect():
        rows.setdefault(r["dim"], []).append((r["class_id"], r["embedding"]))
    return {d: (_unit(np.array([v for _, v in own], np.float64)).astype(np.float32), np.array([i for i, _ in own], np.uint64)) for d, own in rows.items()}


def near_vectors(vectors: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Two rows are linked if the cosine of their vectors is ``cosine`` or more, repeated rows and equal vectors included.
    A component is named by its least id. Vectors that are null or zero, or hold null or non-finite components, are
    linked with nothing and kept; vectors of different length are not compared. Rows with a null id take part by their
    vector; where no row of a component has an id its name is null and its rows are kept. An empty table gives an empty
    result; other columns are not read. Components may be of any number type; all but floats are taken as doubles.
    """
    given = vectors.schema["embedding"].dataType.simpleString()
    kept = given if given == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kept).alias("embedding"))
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(finite & F.exists(numbers, lambda v: v != 0), F.lit(False))
    rows = materialise(rows.withColumn("valid", valid))
    some = rows.filter("valid").select("vec_id", "embedding")
    classes = some.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.withColumns({"class_id": F.monotonically_increasing_id(), "dim": F.size("embedding")}))
    shards = max(SHARDS, math.ceil(classes.count() / SHARD_ROWS))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("class_id"), F.lit(shards)).cast("int"))
    build = _build(cosine, _audit_sample(dealt))
    index = materialise(dealt.select("dim", "shard", "class_id", "n", "embedding").groupBy("dim", "shard").applyInArrow(build, INDEX.format(vector=kept)))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    blocks = index.withColumn("block", every)
    queries = dealt.select("dim", F.col("shard").alias("block"), "class_id", "embedding").withColumn("shard", every)
    keys = ("dim", "shard", "block")
    found = materialise(blocks.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_search(cosine), "class_id long, links long, other long"))
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = connected_components(found, "class_id", "other").withColumnRenamed("node", "class_id")
    named = classes.select("class_id", "embedding", "least", "n").join(links, "class_id", "left").join(joined, "class_id", "left")
    named = materialise(named.select("embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component")))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("embedding", "n_links", "component_id")
    out = some.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
