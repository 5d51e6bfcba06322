import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from puspark.llm import bpe
from tests.llm.helpers import docs

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def by_rank(merges, text):
    """Merge the pair of the least rank, leftmost first, until there is none."""
    tokens = list(text)
    rank = {(merges.spelled[a], merges.spelled[b]): n for (a, b), n in merges.pairs.items()}
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in rank]
        if not found:
            return tokens
        i = min(found)[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def test_backtracking_equals_merging_by_rank():
    rng = random.Random(1)
    for _ in range(60):
        spelled, merges = list("abc"), []
        while len(merges) < 14:
            pair = (rng.choice(spelled), rng.choice(spelled))
            if pair[0] + pair[1] not in spelled:
                merges.append(pair)
                spelled.append(pair[0] + pair[1])
        own = bpe.Merges("abc", merges)
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(25)))
            assert [own.spelled[t] for t in own.encode(text)] == by_rank(own, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeinrst'sdS 019!?.\n\x85\xa0\x1céÉ́ßẞİΣσ日本🙂") | st.characters(codec="utf-8"), max_size=60))
def test_any_text_equals_the_library(vocabulary, text):
    ids = vocabulary.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    (decoded,) = bpe._decoded(vocabulary, pa.array([ids], pa.list_(pa.int32())))
    assert decoded.to_pylist() == [LIBRARY.decode(ids, skip_special_tokens=False)]


def test_rows_of_a_table(spark):
    texts = [None, "", "  \n", "Hello <|startoftext|>World<|endoftext|>!!", "don't", "don't", "a" * 100_000, "th" * 20_000 + " x", "Ωmega ΑΣ"]
    table = docs(spark, list(enumerate(texts)) + [(None, "no id")], extra=("ids", "decoded"))
    rows = bpe.decode(bpe.encode(table, PATH), PATH, keep=("doc_id", "ids")).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        text = "no id" if row["doc_id"] is None else texts[row["doc_id"]] or ""
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert row["ids"] == want
        assert row["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)


def test_empty_table_null_lists_and_clashes(spark):
    table = docs(spark, [(1, "x")], extra=("ids",))
    assert bpe.encode(table.filter(F.lit(False)), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>"), PATH).select("decoded").distinct().collect() == [("",)]
    with pytest.raises(ValueError):
        bpe.encode(table, PATH, keep=("doc_id", "ids"))


def test_all_documents_equal_the_library(spark, small):
    rows = bpe.encode(spark.read.parquet(f"{small}/documents.parquet"), PATH, keep=("text",)).collect()
    assert rows and all(r["ids"] == LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids for r in rows)


def test_other_kinds_of_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises((ValueError, TypeError)):
        bpe.Vocabulary(file.read())


def test_frequent_words_stay_known(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 8)
    with open(PATH, encoding="utf-8") as file:
        own = bpe.Vocabulary(file.read())
    made, word_ids = [], own.word_ids
    monkeypatch.setattr(own, "word_ids", lambda word: made.append(word) or word_ids(word))
    text = " ".join(f"the q{chr(97 + i // 26)}{chr(97 + i % 26)}zx" for i in range(300))
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert made.count("the") == 1 and len(made) == 301
