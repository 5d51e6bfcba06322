import random

import pytest

from puspark.llm import line_dedup
from tests.llm.helpers import docs, words

SPACES = " \t\n\v\f\r"


def brute(rows, least):
    """Lines that go, by trying every run of lines: rows in order of id (null last) and text, equal rows as one."""
    seen, out = {}, {}
    order = sorted({(i is None, i or 0, t) for i, t in rows if t}, key=lambda r: (r[0], r[1]))
    for none, i, text in order:
        lines = [line.strip(SPACES) for line in text.split("\n") if line.strip(SPACES)]
        gone = set()
        runs = {}
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(words(x)) for x in lines[a : b + 1]) >= least:
                    run = tuple(lines[a : b + 1])
                    if run in seen or (run in runs and a > runs[run]):
                        gone |= set(range(a, b + 1))
                    runs.setdefault(run, b)
        for run in runs:
            seen.setdefault(run, True)
        out[(none, i, text)] = gone
    return {k: line_dedup.without_lines(k[2], g) for k, g in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passages = [[say(rng.randint(1, 6)) for _ in range(rng.randint(1, 6))] for _ in range(6)]
    out = []
    for k in range(50):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [say(rng.randint(0, 8))]
        out.append((k, "\n".join(("  " if rng.random() < 0.3 else "") + x + rng.choice(["", "\r", " "]) for x in lines)))
    return out + [(60, None), (61, ""), (62, "\n \n"), (None, out[9][1]), (63, "x y z\n" * 30), (64, out[7][1]), (64, out[7][1]), (65, "a b c d e f g h i j k l")]


def test_repeated_runs_go(spark, rows):
    table = docs(spark, rows, extra=("runs", "n_removed", "text_key"))
    got = line_dedup.dedup_lines(table, least=10).collect()
    want = brute(rows, 10)
    assert len(got) == len(rows)
    for r in got:
        before = next(t for i, t in rows if i == r["doc_id"]) if r["doc_id"] is not None else rows[53][1]
        assert r["text"] == (want[(r["doc_id"] is None, r["doc_id"] or 0, before)] if before else before), r
    assert sum(r["n_removed"] > 0 for r in got) > 10


def test_passage_of_fifty_words_goes_from_later_documents_only(spark):
    passage = "\n".join(" ".join(f"p{k}{j}" for j in range(9)) for k in range(6))  # 54 words in 6 lines
    rows = [(1, f"one\n{passage}\nend one"), (2, f"two\n{passage}\nend two"), (3, f"three\n{passage[:200]}"), (4, "clean text\nshort"), (5, "clean text\nshort")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == dict(rows) | {2: "two\nend two"}


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"line {k} of a very long text" for k in range(30_000))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, [(1, long), (2, "start\n" + long), (3, "w " * 300_000)])).collect()}
    assert got[1]["text"] == long and got[2]["text"] == "start" and got[2]["n_removed"] == 30_000 and got[3]["n_removed"] == 0
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
