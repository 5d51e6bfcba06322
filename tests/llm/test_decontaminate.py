import random
import re

import numpy as np
import pytest

from puspark.llm import decontaminate as dc
from tests.llm.helpers import ascii_lower, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, bench):
    windows = {}
    for item, text in bench:
        w = WORD.findall(ascii_lower(text or ""))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w = WORD.findall(ascii_lower(text or ""))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                own = windows.get(tuple(w[k : k + size]))
                if own:
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["a", "bé", "C", "dd", "e", "Éf", "g9"]) for _ in range(n))
    bench = [(k, say(rng.randint(14, 40))) for k in range(12)] + [(50, "a dd e"), (51, ""), (52, None), (None, say(20)), (3, say(15)), (50, "a dd e")]
    rows = [(k, say(rng.randint(0, 200))) for k in range(60)]
    rows += [(100 + k, say(30) + ", " + bench[k][1].upper().replace("É", "é") + "; " + say(30)) for k in range(8)]
    rows += [(200, None), (201, ""), (202, "--- !"), (None, bench[0][1]), (100, rows[0][1]), (100, rows[0][1]), (203, (say(50) + "\n") * 2000 + bench[1][1])]
    return rows, bench


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 300])
def test_hits_are_those_of_brute_force(spark, case, block):
    rows, bench = case
    table = docs(spark, rows, extra=("spans", "items"))
    got = dc.scan(table, items(spark, bench), block_bytes=block).withColumns({"n_hit": dc.n_hit(), "bad": dc.is_contaminated()}).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["bad"]) for r in got), key=str) == brute(rows, bench)


def test_spans_cut_the_passages(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen"
    table = docs(spark, [(1, f"é start, {passage}. End"), (2, "nothing"), (3, None)])
    got = {r["doc_id"]: r for r in dc.scan(table, items(spark, [(9, passage)])).withColumn("clean", dc.without_spans()).collect()}
    assert got[1]["clean"] == "é start, . End" and got[2]["clean"] == "nothing" and got[3]["clean"] is None
    assert [(s["first_word"], s["end_word"], s["start"], s["end"]) for s in got[1]["spans"]] == [(2, 15, 9, 9 + len(passage))]


def test_empty_tables(spark, case):
    rows, bench = case
    assert dc.scan(docs(spark, []), items(spark, bench)).count() == 0
    got = dc.scan(docs(spark, rows), items(spark, [])).collect()
    assert len(got) == len(rows) and not any(r["items"] or r["spans"] for r in got)


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 5, 600)
    symbols[-1] = 0
    index = dc.FMIndex(symbols, 4)
    patterns = rng.integers(1, 5, (80, 3))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        there = [k for k in range(len(symbols) - 2) if (symbols[k : k + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == there
    order = dc.suffix_array(symbols)
    assert sorted(order.tolist()) == list(range(len(symbols)))


