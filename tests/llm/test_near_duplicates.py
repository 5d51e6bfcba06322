import random
import time

import numpy as np
import pyarrow as pa
import pytest

from puspark.llm import near_duplicates as nd
from puspark.llm.components import connected_components
from tests.llm.helpers import Union, ascii_lower, docs, words


def shingles(text, k):
    w = words(ascii_lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """Component names per row, by comparing all pairs; rows are nodes, the name is the least id."""
    sets = [shingles(t, k) for _, t in rows]
    union = Union(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                union.join(i, j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            root = union.find(i)
            names[root] = min(doc_id, names.get(root, doc_id))
    return sets, [names.get(union.find(i)) for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    say = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(n)]
    out, next_id = [], 1000
    for group in range(12):  # copies with changed words, around the threshold
        base = say(rng.randint(30, 200))
        for _ in range(rng.randint(2, 25)):
            own = [w if rng.random() > 0.03 * (group % 4) else "new" + str(rng.random()) for w in base]
            out.append((next_id, " ".join(own)))
            next_id -= rng.randint(1, 3)
    shared = say(60)
    out += [(2000 + k, " ".join(say(rng.randint(5, 60)) + shared)) for k in range(40)]  # a passage in common
    out += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "two words"), (3004, "TWO  words"), (3005, "two words more"), (3006, "éÉ two words")]
    out += [(None, out[0][1]), (None, "alone without an id at all"), (3010, out[5][1].upper()), (3010, out[5][1]), (3010, out[5][1]), (4000, " ".join(say(30_000)))]
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_components_are_those_of_brute_force(spark, rows, k):
    got = nd.near_duplicates(docs(spark, rows, extra=("class_id", "kept")), k=k).collect()
    sets, names = brute(rows, k, 80)
    want = sorted(((i, len(s), n, i == n) for (i, _), s, n in zip(rows, sets, names)), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == want
    assert len({n for n in names}) < len(rows) - 30  # groups there are


@pytest.mark.parametrize("crowded", [1 << 18, 30])
def test_regions_cut_and_split_over_partitions(spark, rows, monkeypatch, crowded):
    monkeypatch.setattr(nd, "REGION", 8)
    monkeypatch.setattr(nd, "REGION_SHINGLES", 2000)
    monkeypatch.setattr(nd, "CROWDED", crowded)
    monkeypatch.setattr(nd, "DEEP", crowded)
    monkeypatch.setattr(nd, "DEEP_AGAIN", crowded)
    monkeypatch.setattr(nd, "DEEPER", ((6, 40), (10, 160)))
    got = nd.near_duplicates(docs(spark, rows), k=4).collect()
    _, names = brute(rows, 4, 80)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(i), str(n)) for (i, _), n in zip(rows, names))


def test_one_row_of_each_component_stays(spark, rows):
    table = docs(spark, rows, extra=("first",))
    got = nd.without_near_duplicates(table)
    assert got.columns == table.columns
    sets, names = brute(rows, 5, 80)
    with_ids = [n for s, n in zip(sets, names) if s and n is not None]
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i not in (None, 3000, 3001, 3002)) == sorted(set(with_ids))
    assert {3000, 3001, 3002} <= set(ids) and ids.count(None) == 1


def test_empty_table(spark):
    assert nd.near_duplicates(docs(spark, [])).count() == 0
    got = nd.near_duplicates(docs(spark, [(2, ""), (1, None)])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def _sorted_rows(sketches, sizes):
    """Rows of one task, each of its own component, as they stand in a partition."""
    labels = [bytes(4 * nd.PREFIX) + s for s in sketches]
    ids = [k.to_bytes(8, "big") * 2 for k in range(len(labels))]
    numbers = {"task": pa.array([0] * len(labels), pa.int64()), "size": pa.array(sizes, pa.int64()), "block": pa.array([0] * len(labels), pa.int8())}
    return pa.table(numbers | {"label": pa.array(labels, pa.binary()), "class_id": pa.array(ids, pa.binary()), "component": pa.array(ids, pa.binary())})


def _met(batch):
    """Pairs of class ids that meet in a piece."""
    pieces = {}
    for piece, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        pieces.setdefault(piece, []).append(int.from_bytes(own[:8], "big"))
    return {(a, b) for own in pieces.values() for a in own for b in own if a < b}, pieces


def test_candidates_of_any_size_meet():
    sketches = [bytes([k] * 10 + [7] * (nd.MINIMA - 10)) for k in range(2)]
    table = _sorted_rows(sketches, [600_000, 600_000])
    assert _met(nd._pieces_of(table, 0, nd.LEAST_SHARED)[0])[0] == {(0, 1)}
    rng = np.random.default_rng(1)
    sketches = rng.integers(0, 256, (60, nd.MINIMA), np.uint8)
    sketches[:, 12:] = 7
    sizes = rng.integers(1, nd.REGION_SHINGLES // 4, 60)
    pairs, pieces = _met(nd._pieces_of(_sorted_rows([s.tobytes() for s in sketches], sizes), 0, nd.LEAST_SHARED)[0])
    assert pairs == {(a, b) for b in range(60) for a in range(b)}
    assert max(sizes[own].sum() for own in pieces.values()) <= nd.REGION_SHINGLES


def test_long_texts_are_linked(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4):  # of similarity 0.82, over half of what one task holds each
        words = rng.integers(0, 1 << 26, 560_000)
        rows.append((2 * k, " ".join(map(str, words))))
        words[:56_000] = rng.integers(0, 1 << 26, 56_000)
        rows.append((2 * k + 1, " ".join(map(str, words))))
    got = nd.near_duplicates(docs(spark, rows), k=4).select("doc_id", "component_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(8)}


def test_every_pair_across_components_of_a_crowded_region_meets(spark, monkeypatch):
    monkeypatch.setattr(nd, "REGION", 8)
    n, name = 45, lambda k: k.to_bytes(8, "big") * 2
    component = [0 if k < 20 else 20 + (k - 20) // 2 for k in range(n)]
    dense = [(t, bytes([t] * 12 + [k] * nd.MINIMA), name(k), 5) for t, k in [(0, k) for k in range(n)] + [(1, 1), (1, 2), (1, 44)] + [(2, k) for k in range(20)]]
    dense = spark.createDataFrame(dense, "tree int, label binary, class_id binary, size long")
    grouped = spark.createDataFrame([(name(k), name(c)) for k, c in enumerate(component) if k < 40], "node binary, component binary")
    known = dense.join(grouped.toDF("class_id", "component"), "class_id", "left").selectExpr("tree", "label", "class_id", "size", "coalesce(component, class_id) component")
    component[40:] = range(40, 45)
    tasks, seen = {}, {}
    for r in nd._tasks(known, nd._regions(known)).collect():
        tasks.setdefault((r["task"], bytes(r["label"])[0]), []).append((int.from_bytes(r["class_id"][:8], "big"), r["block"]))
    for (_, tree), own in tasks.items():
        for a, x in own:
            for b, y in own:
                if component[a] < component[b] and (x != y or x == 0):
                    seen[tree, a, b] = seen.get((tree, a, b), 0) + 1
    want = {(0, a, b) for a in range(n) for b in range(n) if component[a] < component[b]} | {(1, 1, 44), (1, 2, 44)}
    assert seen == dict.fromkeys(want, 1)
    assert len(tasks) > 20


def _boilerplate(n, seed):
    """Texts of 170 words that share 130 of them (similarity 0.6), and pairs of about 0.8 to 0.85 among them."""
    rng = random.Random(seed)
    shared = [f"w{i}" for i in range(130)]
    rows, pairs = [], 0
    for i in range(n):
        own = [f"o{rng.randrange(1 << 40)}" for _ in range(40)]
        rows.append((2 * i, " ".join(own + shared)))
        if i % 20 == 0:
            changed = [w if j >= 15 + i % 3 else f"c{rng.randrange(1 << 40)}" for j, w in enumerate(own)]
            rows.append((2 * i + 1, " ".join(changed + shared)))
            pairs += 1
    return rows, pairs


def test_a_crowded_region_keeps_its_links(spark):
    """6,000 texts with a long passage in common: nothing is linked but the planted pairs, and all of these are."""
    rows, pairs = _boilerplate(5700, 3)
    start = time.monotonic()
    got = nd.near_duplicates(docs(spark, rows), k=4).select("doc_id", "component_id").collect()
    took = time.monotonic() - start
    linked = [r for r in got if r["doc_id"] != r["component_id"]]
    sets = {i: shingles(t, 4) for i, t in rows}
    want = {i for i in sets if i % 2 and 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1])}
    assert pairs == 285 and len(want) > 200
    assert {r["doc_id"] for r in linked} == want and all(r["component_id"] == r["doc_id"] - 1 for r in linked)
    assert took < 60


def test_rows_that_meet_in_several_trees_are_one_piece():
    sketches = [bytes([k] * 10 + [7] * (nd.MINIMA - 10)) for k in range(3)]
    one = _sorted_rows(sketches, [5, 6, 7])
    tables = [one.set_column(one.column_names.index("task"), "task", pa.array([t] * 3, pa.int64())) for t in (1, 2)]
    tables = [t.append_column("part", pa.array([0] * 3, pa.int32())) for t in tables]
    found = pa.Table.from_batches(nd._second_round(nd.LEAST_SHARED)(b.combine_chunks().to_batches()[0] for b in tables))
    assert found.num_rows == 6 and len(set(found["piece"].to_pylist())) == 1
    other = nd._second_round(nd.LEAST_SHARED)(t.slice(1).combine_chunks().to_batches()[0] for t in tables[:1])
    assert set(next(other).column("piece").to_pylist()).isdisjoint(found["piece"].to_pylist())


def test_texts_that_are_not_wanted_are_not_shuffled(spark, monkeypatch):
    texts = spark.range(20_000).selectExpr("if(id = 7, null, id) doc_id", "xxhash64('text', id) text_key", "'x' text")
    wanted = texts.filter("doc_id is null or doc_id % 50 = 0").selectExpr("text class_id", "doc_id i", "text_key t")
    names = {(r["i"], r["t"]) for r in wanted.collect()}
    kept = {(r["doc_id"], r["text_key"]) for r in nd._filtered(texts, wanted).collect()}
    assert names <= kept and len(kept) < 2000
    monkeypatch.setattr(nd, "MOST_FILTER_BITS", 1 << 8)  # full: all that is wanted is still there
    assert names <= {(r["doc_id"], r["text_key"]) for r in nd._filtered(texts, wanted).collect()}
    assert nd._filtered(texts, wanted.limit(0)).count() == 0


def test_few_edges_make_few_files(spark):
    conf, old = "spark.sql.adaptive.coalescePartitions.enabled", {}
    for name, value in ((conf, "false"), ("spark.sql.shuffle.partitions", "40")):
        old[name] = spark.conf.get(name, "true")
        spark.conf.set(name, value)
    try:
        found = connected_components(spark.range(300).selectExpr("id a", "id + 1 b"))
        assert {r["component"] for r in found.collect()} == {0} and found.count() == 301
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
