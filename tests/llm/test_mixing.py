from puspark.llm import mixing
from tests.llm.helpers import docs, words

ROWS = [(i, "w " * (i % 7), None, f"s{i % 3}") for i in range(60)]
AWKWARD = [(100, None, None, "s0"), (101, "", None, "s1"), (None, "a b", None, None), (5, "w w w w w", None, "s2"), (5, "w w w w w", None, "s2"), (102, "é " * 40_000, None, "hot")]


def expected_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= w[s] * level}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix_takes_each_sources_budget(spark):
    rows = ROWS + AWKWARD
    got = mixing.mix(docs(spark, rows, extra=("taken", "size", "key"))).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = expected_targets(sizes)
    for source, size in sizes.items():
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {size}
        assert all(abs(r["target"] - want[source]) < 1e-6 for r in own)
        assert sum(r["taken"] for r in own) == int(want[source] + 0.5)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert {r["taken"] for r in got if r["doc_id"] in (100, 101)} == {0}
    again = mixing.mix(docs(spark, rows).repartition(1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_copies_give_the_taken_words(spark):
    rows = ROWS + AWKWARD[:3]
    mixed = mixing.mix(docs(spark, rows), keep=("doc_id", "text"))
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    found = {}
    for r in mixing.copies(mixed).collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == found


def test_empty_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    only = mixing.mix(docs(spark, [(1, ""), (2, None)])).collect()
    assert [(r["target"], r["taken"]) for r in only] == [(0.0, 0), (0.0, 0)]
