"""A hierarchical navigable small-world graph over unit vectors (Malkov and Yashunin, 2018), in batches of NumPy.

Layers are built from the top; every layer holds the nodes of the one above, which are its entry points. A batch of
nodes is searched in the layer as far as it is built and among itself, and linked to neighbours that are closer to it
than to each other; links back are pruned by the same rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links per node when it is added, and at most; nodes that are linked by comparing all; nodes per batch.
LINKS, MOST_LINKS = 12, 24
FIRST, BATCH = 192, 512
BUILD_BEAM = 40
#: Entries of the visited table of one search.
VISITED = 1 << 24


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in descending order."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")


def _pick(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in descending order (-1: none) those closer to the node than to a picked one; then the nearest rest."""
    out = np.full((len(ids), most), -1, np.int32)
    for at in range(0, len(ids), 1024):
        own, sim = ids[at : at + 1024], sims[at : at + 1024]
        vectors = x[np.maximum(own, 0)]
        among = vectors @ vectors.transpose(0, 2, 1)
        covered = np.full(sim.shape, -2.0, np.float32)
        picked = np.zeros(sim.shape, bool)
        for j in range(own.shape[1]):
            take = (own[:, j] >= 0) & (sim[:, j] > covered[:, j]) & (picked.sum(axis=1) < most)
            picked[:, j] = take
            covered[take] = np.maximum(covered[take], among[take, :, j])
        rank = np.where(own < 0, 2, np.where(picked, 0, 1)) * own.shape[1] + np.arange(own.shape[1])
        best = np.argsort(rank, axis=1)[:, :most]
        chosen = np.take_along_axis(own, best, 1)
        out[at : at + len(own), : chosen.shape[1]] = chosen
    return out


@dataclass
class Layer:
    """``nodes`` in the order they were added, and neighbours of each, as places in ``nodes`` (-1: none)."""

    nodes: np.ndarray
    links: np.ndarray


def _beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of about the nearest ``width`` nodes of each query, in descending order."""
    n = len(x)
    ids, sims = [], []
    step = max(1, VISITED // n)
    for at in range(0, len(queries), step):
        q, start = queries[at : at + step], entries[at : at + step]
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), bool)
        found = start.astype(np.int32)
        sim = np.where(found >= 0, np.einsum("qd,qkd->qk", q, x[np.maximum(found, 0)]), -3).astype(np.float32)
        first = np.ones(found.shape, bool)  # an entry given twice counts once
        for j in range(1, found.shape[1]):
            first[:, j] = (found[:, :j] != found[:, j : j + 1]).all(axis=1)
        found, sim = np.where(first, found, -1), np.where(first, sim, -3).astype(np.float32)
        seen[rows, np.maximum(found, 0)] |= found >= 0
        best = _top(sim, width)
        found, sim = np.take_along_axis(found, best, 1), np.take_along_axis(sim, best, 1)
        closed = found < 0
        live = np.arange(len(q))
        while len(live):
            # the next unexpanded nodes of every beam that has some
            order = np.argsort(closed[live], axis=1, kind="stable")[:, :4]
            fresh = ~np.take_along_axis(closed[live], order, 1)
            some = fresh.any(axis=1)
            live, order, fresh = live[some], order[some], fresh[some]
            if not len(live):
                break
            expand = np.where(fresh, np.take_along_axis(found[live], order, 1), -1)
            closed[live[:, None], order] = True
            near = np.where(expand[:, :, None] >= 0, links[np.maximum(expand, 0)], -1).reshape(len(live), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(new)
            seen[live[r], near[r, c]] = True
            value = np.full(near.shape, -3, np.float32)
            value[r, c] = np.einsum("kd,kd->k", q[live[r]], x[near[r, c]])
            all_ids = np.concatenate((found[live], np.where(new, near, -1)), axis=1)
            all_sims = np.concatenate((sim[live], value), axis=1)
            all_closed = np.concatenate((closed[live], ~new), axis=1)
            best = _top(all_sims, width)
            if best.shape[1] > found.shape[1]:
                grow = best.shape[1] - found.shape[1]
                found = np.pad(found, ((0, 0), (0, grow)), constant_values=-1)
                sim = np.pad(sim, ((0, 0), (0, grow)), constant_values=-3)
                closed = np.pad(closed, ((0, 0), (0, grow)), constant_values=True)
            found[live] = np.take_along_axis(all_ids, best, 1)
            sim[live] = np.take_along_axis(all_sims, best, 1)
            closed[live] = np.take_along_axis(all_closed, best, 1)
        pad = max(0, width - found.shape[1])
        ids.append(np.pad(found, ((0, 0), (0, pad)), constant_values=-1)[:, :width])
        sims.append(np.pad(sim, ((0, 0), (0, pad)), constant_values=-3)[:, :width])
    if not ids:
        return np.zeros((0, width), np.int32), np.zeros((0, width), np.float32)
    return np.concatenate(ids), np.concatenate(sims)


def _build_layer(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Neighbours of every row of ``x``; ``entries``: places of earlier rows to start the search of each row from."""
    n = len(x)
    links = np.full((n, MOST_LINKS), -1, np.int32)
    m = min(n, FIRST)
    sims = x[:m] @ x[:m].T
    np.fill_diagonal(sims, -3)
    best = _top(sims, min(BUILD_BEAM, m))
    own = np.take_along_axis(sims, best, 1)
    links[:m] = _pick(x, np.where(own > -3, best, -1), own, MOST_LINKS)
    done = m
    while done < n:
        rows = np.arange(done, min(n, done + min(BATCH, done)))
        start = np.column_stack((np.where(entries[rows] < done, entries[rows], -1), np.zeros(len(rows), np.int32)))
        found, sims = _beam(x[:done], links[:done], x[rows], start, BUILD_BEAM)
        among = x[rows] @ x[rows].T
        among[np.triu_indices(len(rows))] = -3  # rows before it in the batch
        mates = _top(among, min(LINKS, len(rows)))
        near = np.concatenate((found, np.where(np.take_along_axis(among, mates, 1) > -3, rows[mates], -1)), axis=1)
        sims = np.concatenate((sims, np.take_along_axis(among, mates, 1)), axis=1)
        order = _top(sims, BUILD_BEAM)
        picked = _pick(x, np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1), LINKS)
        links[rows, :LINKS] = picked
        source = np.repeat(rows, LINKS)[picked.ravel() >= 0]
        target = picked.ravel()[picked.ravel() >= 0]
        value = np.einsum("kd,kd->k", x[source], x[target])
        order = np.lexsort((-value, target))
        source, target, value = source[order], target[order], value[order]
        heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, int)
        sizes = np.diff(np.append(heads, len(target)))
        place = np.arange(len(target)) - np.repeat(heads, sizes)
        use = place < MOST_LINKS  # the nearest; the others reach the node by their own links
        touched = target[heads]
        incoming = np.full((len(touched), MOST_LINKS), -1, np.int32)
        incoming[np.repeat(np.arange(len(touched)), sizes)[use], place[use]] = source[use]
        both = np.concatenate((links[touched], incoming), axis=1)
        near = np.where(both >= 0, np.einsum("td,tkd->tk", x[touched], x[np.maximum(both, 0)]), -3).astype(np.float32)
        full = (both >= 0).sum(axis=1) > MOST_LINKS
        order = np.argsort(-near, axis=1, kind="stable")
        both, near = np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1)
        links[touched[~full]] = both[~full, :MOST_LINKS]
        links[touched[full]] = _pick(x, both[full], near[full], MOST_LINKS)
        done += len(rows)
    return links


@dataclass
class Graph:
    """Layers from the top down; the last holds all rows."""

    x: np.ndarray
    layers: list[Layer]

    def search(self, queries: np.ndarray, width: int, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of about the nearest ``width`` (-1: none), from layers above ``stop`` only if given."""
        entries = np.zeros((len(queries), 1), np.int32)
        found = sims = None
        layers = self.layers[:stop]
        for k, layer in enumerate(layers):
            place, sims = _beam(self.x[layer.nodes], layer.links, queries, entries, width if k == len(layers) - 1 else 4)
            found = np.where(place >= 0, layer.nodes[np.maximum(place, 0)], -1)
            if k + 1 < len(layers):
                where = _places(self.layers[k + 1].nodes, len(self.x))
                entries = np.where(found >= 0, where[np.maximum(found, 0)], -1)
        return found, sims


def _places(nodes: np.ndarray, n: int) -> np.ndarray:
    where = np.full(n, -1, np.int32)
    where[nodes] = np.arange(len(nodes))
    return where


def levels(keys: np.ndarray) -> np.ndarray:
    """Geometric levels from 64-bit hashes."""
    u = (keys.astype(np.float64) + 1) / 2.0**64
    return np.floor(-np.log(np.minimum(u, 1 - 1e-12)) / np.log(LINKS)).astype(np.int32)


def build(x: np.ndarray, level: np.ndarray) -> Graph:
    """Graph over the unit rows of ``x``. Rows of the highest level come first in every layer."""
    graph = Graph(x, [])
    order = np.argsort(-level, kind="stable")
    top = int(level.max(initial=0))
    for height in range(top, -1, -1):
        nodes = order[: int((level >= height).sum())]
        if height and len(nodes) < 2:
            continue
        entries = np.zeros((len(nodes), 1), np.int32)
        if graph.layers:
            found, _ = graph.search(x[nodes], 4)
            where = _places(nodes, len(x))
            entries = np.where(found >= 0, where[np.maximum(found, 0)], -1)
        graph.layers.append(Layer(nodes, _build_layer(x[nodes], entries)))
    return graph
