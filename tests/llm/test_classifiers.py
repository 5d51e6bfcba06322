"""Quality and language: held-out accuracy on the given tables, and awkward rows."""

import pytest

from puspark.llm import language, quality, queries
from puspark.sources import read_table
from tests.llm.helpers import docs

GIVEN = "/root/testdata/sf0.01"
AWKWARD = [(1, None), (2, ""), (3, "12 !! ..."), (None, "the heron"), (4, "the"), (4, "the"), (5, "a b " * 200_000)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, None) for k in range(40)] + [(3, 0, None), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    got = queries.op4_quality(spark, GIVEN)
    assert got.count() == read_table(spark, GIVEN, "documents").count()
    held = got.filter("held_out").join(read_table(spark, GIVEN, "labels"), "doc_id").select("predicted", "quality", "score").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in held)


def test_quality_of_awkward_rows(spark, labels):
    table = docs(spark, AWKWARD + [(k, "word other. " * k) for k in range(10, 40)], extra=("score", "x", "quality"))
    x = quality.measured(table)
    model = quality.fit(x, labels)
    assert len(model.factors) == 2
    got = quality.scored(x, model).collect()
    assert len(got) == 37 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.accepted(table, model, 0.0)
    assert kept.columns == table.columns and sorted(map(str, kept.collect())) == sorted(map(str, table.collect()))
    assert quality.accepted(table, model, 1.1).count() == 0


def test_quality_without_rows_of_a_class(spark, labels):
    x = quality.measured(docs(spark, AWKWARD))
    model = quality.fit(x, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.scored(x, model).collect()} == {0.5}
    assert quality.scored(quality.measured(docs(spark, [])), model).count() == 0


def test_learned_rows_are_those_of_the_other_folds(spark):
    got = queries.op4_quality(spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    got = queries.op7_language(spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_language_on_held_out_rows(spark):
    got = queries.op7_language(spark, GIVEN)
    held = got.filter("held_out").join(read_table(spark, GIVEN, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_of_awkward_rows(spark):
    learn = docs(spark, [(k, t, g) for k, (t, g) in enumerate([("the heron then", "en"), ("der die und", "de"), ("x", None), (None, "fr"), ("", "es"), ("12", "it")])])
    model = language.fit(learn)
    assert model[0] == ["de", "en"]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language.identify(docs(spark, AWKWARD, extra=("score", "lang_pred")), model).collect()}
    with pytest.raises(ValueError):
        language.identify(docs(spark, AWKWARD, extra=("score",)), model, ("doc_id", "score"))
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en")} <= set(got)
    assert got[(1, "und")] == 0 and all(0 <= s <= 1 for s in got.values())


def test_any_number_of_languages_in_blocks(spark, monkeypatch):
    rows = [(k, f"{chr(97 + k)}{chr(97 + k * 7 % 26)} word{chr(97 + k)} {chr(98 + k)}", f"l{k:02}") for k in range(20)]
    learn, asked = docs(spark, rows), docs(spark, rows + AWKWARD)
    whole = sorted(map(tuple, language.identify(asked, language.fit(learn)).collect()), key=str)
    monkeypatch.setattr(language, "LANGUAGES", 3)
    parts = sorted(map(tuple, language.identify(asked, language.fit(learn)).collect()), key=str)
    assert [r[:2] for r in parts] == [r[:2] for r in whole]
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(parts, whole))


def test_language_with_nothing_learned(spark):
    model = language.fit(docs(spark, []))
    got = language.identify(docs(spark, AWKWARD), model).collect()
    assert len(got) == len(AWKWARD) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language.identify(docs(spark, []), model).count() == 0


def test_scores_are_those_of_plain_gaussians(spark):
    """The discriminant by explicit inverses and determinants over all learned rows, from the same statistics."""
    import zlib

    import numpy as np
    import pyarrow as pa

    folder = "/root/testdata/sf0.001"
    rows = read_table(spark, folder, "documents").select("doc_id", "text").collect()
    label = {r["doc_id"]: r["quality"] for r in read_table(spark, folder, "labels").collect()}
    x = dict(zip((r["doc_id"] for r in rows), quality._matrix(pa.array([r["text"] for r in rows], pa.string()))))
    learned = [i for i in x if label.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    z, y = np.array([x[i] for i in learned]), np.array([label[i] for i in learned])
    centre = z.mean(axis=0)
    within = sum(((z[y == c] - z[y == c].mean(axis=0)) ** 2).sum(axis=0) for c in (0, 1)) / len(z)
    scale = np.sqrt(np.maximum(within, 1e-6))
    z = (z - centre) / scale
    pooled = sum((z[y == c] - z[y == c].mean(axis=0)).T @ (z[y == c] - z[y == c].mean(axis=0)) for c in (0, 1)) / len(z)
    parts = []
    for c in (0, 1):
        own = (1 - quality.POOLED) * np.cov(z[y == c].T, bias=True) + quality.POOLED * pooled
        own = (1 - quality.SPHERE) * own + quality.SPHERE * max(np.trace(own) / len(own), 1e-3) * np.eye(len(own))
        parts.append((z[y == c].mean(axis=0), np.linalg.inv(own), np.linalg.slogdet(own)[1], np.log((y == c).mean())))
    want = {}
    for i, row in x.items():
        v = (row - centre) / scale
        a, b = (p - 0.5 * d - 0.5 * (v - m) @ inv @ (v - m) for m, inv, d, p in parts)
        want[i] = 1 / (1 + np.exp(np.clip(a - b, -700, 700)))
    got = {r["doc_id"]: r["score"] for r in queries.op4_quality(spark, folder).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_languages_are_those_of_counting_by_hand(spark):
    """Naive Bayes over n-grams made one by one, with the same hash."""
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    sounds = {"aa": "thé an ion ", "bb": "der ung sch ", "cc": "que ción el "}
    say = lambda g: "".join(rng.choice(sounds[g].split()) + rng.choice(["", " ", ", ", " 12 "]) for _ in range(rng.randrange(1, 12)))
    rows = [(k, say(g), g) for k, g in enumerate(rng.choice(list(sounds)) for _ in range(60))] + [(90, "A", "aa"), (91, "...", "bb"), (92, None, "aa")]

    def hashed(value):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            value = ((value ^ (value >> shift)) * factor) % (1 << 64)
        return (value ^ (value >> 31)) % language.BUCKETS

    def grams(text):
        kept, before = [], True
        for c in (text or "").translate({k: k + 32 for k in range(65, 91)}):
            if c.isalpha() or before or not kept:
                kept.append(ord(c) if c.isalpha() else 32)
            before = c.isalpha()
        out = []
        for n in (1, 2, 3):
            for i in range(len(kept) - n + 1):
                if any(c != 32 for c in kept[i : i + n]):
                    value = n
                    for c in kept[i : i + n]:
                        value = (value << 21 | c) % (1 << 64)
                    out.append(hashed(value))
        return out

    counts, texts = {g: Counter() for g in sounds}, Counter()
    for _, text, g in rows:
        counts[g].update(grams(text))
        texts[g] += any(c.isalpha() for c in text or "")
    total = {g: sum(c.values()) + language.SMOOTHING * language.BUCKETS for g, c in counts.items()}
    got = {r["doc_id"]: r for r in language.identify(docs(spark, rows), language.fit(docs(spark, rows))).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        like = {g: math.log(texts[g] / sum(texts.values())) + sum(math.log((counts[g][b] + language.SMOOTHING) / total[g]) for b in grams(text)) for g in sounds}
        best = max(sorted(like), key=like.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(math.exp(v - like[best]) for v in like.values())) < 1e-9
