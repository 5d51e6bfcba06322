import math

import numpy as np
import pytest

from puspark.llm import embedding_dedup as ed
from puspark.llm import hnsw
from puspark.llm.text import mix
from tests.llm.helpers import Union

SCHEMA = "vec_id long, embedding array<float>, label int, class_id string, n_links long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, cosine=0.9):
    x = [None if v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, np.float32).astype(np.float64) for _, v in rows]
    union, n = Union(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(x):
        for j, b in enumerate(x[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                union.join(i, j)
                n[i] += 1
                n[j] += 1
    names = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            names[union.find(i)] = min(vec_id, names.get(union.find(i), vec_id))
    return sorted(((rows[i][0], n[i], names.get(union.find(i))) for i in range(len(rows))), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = [(k, v) for k, v in enumerate(rng.normal(size=(300, 16)).tolist())]
    for group in range(6):  # tight groups, one larger than a beam
        centre = rng.normal(size=16)
        for _ in range((5, 3, 10, 20, 90, 2)[group]):
            out.append((1000 - len(out), (centre + rng.normal(size=16) * 0.12).tolist()))
    same = out[3][1]
    out += [(2000 + k, same) for k in range(40)] + [(5, same), (5, same), (None, same), (None, rng.normal(size=16).tolist())]
    out += [(3000, None), (3001, [0.0] * 16), (3002, [1.0, None] + [0.0] * 14), (3003, [float("nan")] * 16), (3004, [float("inf")] + [1.0] * 15), (3005, []), (3006, [1.0, 2.0]), (3007, [2.0, 4.0])]
    return out + [(3008, [1e-30 * c for c in same]), (3009, [3e37 * c / max(map(abs, same)) for c in same])]


def test_links_and_components_are_those_of_brute_force(spark, rows):
    got = ed.near_vectors(table(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_tables(spark):
    assert ed.near_vectors(table(spark, [])).count() == 0
    got = ed.near_vectors(table(spark, [(1, None), (2, [0.0])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_graph_finds_neighbours_and_survives_its_table():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = ed._unit((centres[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 24)))).astype(np.float32)
    graph = hnsw.build(x, hnsw.levels(mix(np.arange(3000, dtype=np.uint64) + np.uint64(9))))
    assert len(graph.layers) > 1 and len(graph.layers[-1].nodes) == 3000
    found, sims = graph.search(x[:200], 48)
    exact = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10].tolist())) for a, b in zip(exact.tolist(), found)]) / 10 > 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()


class Lossy:
    """Vectors of which ``pairs`` are linked; searches narrower than 100 find the query itself only."""

    def __init__(self, n, pairs, at=0):
        self.x = np.eye(n, dtype=np.float32)
        for k in range(at, at + 2 * pairs, 2):
            self.x[k + 1] = self.x[k]

    def search(self, queries, width):
        sims = queries @ self.x.T
        order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        near = np.take_along_axis(sims, order, axis=1)
        if width < 100:
            near[:, 1:] = 0
            near[near[:, 0] < 0.9, 0] = 0
        return order, near


@pytest.mark.parametrize("pairs, beam", [(0, 24), (1, 192), (40, 192)])
def test_beam_widens_until_every_audited_link_is_found(pairs, beam):
    """One lost link among 400 vectors is enough; vectors that find themselves prove nothing."""
    none, keys = np.zeros((0, 400), np.float32), np.arange(400, dtype=np.uint64)
    assert ed.audited_beam(Lossy(400, pairs), keys, 0.9, none, keys[:0]) == beam


def test_queries_from_other_shards_are_audited(monkeypatch):
    monkeypatch.setattr(ed, "MOST_AUDITED", 0)
    graph, keys = Lossy(400, 0), np.arange(400, dtype=np.uint64)
    outside = graph.x[7:8] * np.float32(1.0)
    assert ed.audited_beam(graph, keys, 0.9, outside, np.array([7], np.uint64)) == 24  # itself

    class Blind(Lossy):
        def search(self, queries, width):
            order, near = super().search(queries, width)
            return order, near * (width >= 100)

    assert ed.audited_beam(Blind(400, 0), keys, 0.9, outside, np.array([9999], np.uint64)) == 192


@pytest.mark.parametrize("kind", ["double", "int", "decimal(10,2)"])
def test_components_of_any_number_type(spark, kind):
    rows = [(1, [10.0, 0.0]), (2, [9.0, 1.0]), (3, [0.0, 10.0]), (4, [20.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [10.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding as array<{kind}>) as embedding")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ed.near_vectors(table).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (0, 3, True), 4: (3, 1, False), 5: (0, 5, True), 6: (0, 6, True), 7: (3, 1, False)}


def test_doubles_keep_their_precision(spark):
    below = [0.9 - 1e-12, (1 - (0.9 - 1e-12) ** 2) ** 0.5]
    above = [0.9 + 1e-12, (1 - (0.9 + 1e-12) ** 2) ** 0.5]
    rows = [(1, [1e300, 0.0]), (2, below), (3, [0.0] * 2 + [1.0]), (4, [0.0] * 2 + [1.0]), (5, above)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (2, 1)}
