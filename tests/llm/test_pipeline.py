"""Every stage on its own input against the operators' brute-force versions, and the registered queries' coverage."""

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from puspark.llm import decontaminate, quality
from puspark.sources import read_table
from tests.llm.helpers import docs, words
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_duplicates import brute as brute_components

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, SMALL, "documents")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SMALL)
        if name != "mix":
            assert result.columns == read_table(spark, SMALL, "documents").columns
            docs = spark.createDataFrame(result.collect(), read_table(spark, SMALL, "documents").schema)
            out.append((name, docs.collect()))
        else:
            out.append((name, result.collect()))
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mix"]


def test_quality_keeps_what_scores_half(spark, stages):
    docs = read_table(spark, SMALL, "documents")
    x = quality.measured(docs)
    scores = quality.scored(x, quality.fit(x, read_table(spark, SMALL, "labels"))).collect()
    assert {r["doc_id"] for r in stages[1][1]} == {r["doc_id"] for r in scores if r["score"] >= 0.5}
    before = {r["doc_id"]: r for r in stages[0][1]}
    assert all(r == before[r["doc_id"]] for r in stages[1][1])


def test_lines(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1][1]]
    want = {k[1]: v for k, v in brute_lines(before, 50).items()}
    assert {r["doc_id"]: r["text"] for r in stages[2][1]} == {i: want.get(i, t) for i, t in before if i not in want or want[i].strip(" \t\n\v\f\r")}
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][1])


def test_near_duplicates(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[2][1]]
    _, names = brute_components(before, 5, 80)
    assert sorted(r["doc_id"] for r in stages[3][1]) == sorted(i for (i, _), n in zip(before, names) if i == n)


def test_decontamination(spark, stages):
    before = [(r["doc_id"], r["text"]) for r in stages[3][1]]
    bench = [tuple(r) for r in read_table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_hits(before, bench) if r[-1]}
    assert sorted(r["doc_id"] for r in stages[4][1]) == sorted(i for i, _ in before if i not in bad)
    assert decontaminate.RATIO == 20


def test_mix(stages):
    sizes = {r["doc_id"]: len(words(r["text"])) for r in stages[4][1]}
    assert {r["doc_id"]: r["size"] for r in stages[5][1]} == sizes
    assert abs(sum(r["taken"] for r in stages[5][1]) - 1.5 * sum(sizes.values())) <= len(stages[5][1])


def test_run_gives_the_last_stage(spark, stages):
    got = registry.queries()["pipeline"](spark, SMALL)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[5][1]))


def test_one_query_per_operator():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert {"op3_decontaminate", "op5_mix", "op6_line_dedup", "op8_urls", "op9_warc"} <= set(registry.oracle_sql())


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated texts, ties, no rows at all and clashing names; the user's columns come out as they were."""
    folder = str(tmp_path)
    line = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(70))
    rows = [(1, None), (2, ""), (3, " \n"), (4, line), (5, line), (5, line), (None, line), (6, line + "\n" + other), (7, other.upper()), (None, None), (8, "few words")]
    names = ("n_words", "spans", "items", "n_removed", "class_id", "_text_key", "first", "score")
    table = docs(spark, rows, extra=names)
    docs(spark, [(1, "a test item of thirteen words is here so that there is one of it")]).selectExpr("doc_id item_id", "text").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    for empty in (False, True):
        now = table.filter("false") if empty else table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, now, folder)
            assert got.schema.names == table.schema.names
            found = got.collect()
            assert all(r[c] == "x" for r in found for c in names)
            if empty:
                assert not found
            elif name == "line_dedup":
                kept = [(r["doc_id"], r["text"]) for r in found]
                assert sorted(kept, key=str) == sorted([(1, None), (2, ""), (3, " \n"), (4, line), (6, other), (7, other.upper()), (None, None), (8, "few words")], key=str)
            elif name == "near_duplicates":
                assert sorted((r["doc_id"] for r in found), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, None], key=str)
            elif name == "decontamination":
                assert len(found) == len(rows)
        mixed = corpus_pipeline.mix_sources(spark, now, folder).collect()
        assert len(mixed) == (0 if empty else len(rows))
