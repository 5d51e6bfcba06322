import hashlib
import random
import re

import pytest

from puspark.llm import pii
from tests.llm.helpers import docs

# the contract's patterns as they stand
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in twice) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(k, m[0]))


CASES = [
    "a@b@c.d e.f+g@h-i.j..k @x.y q@r@.s a@b.c@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 9.9.9.9x",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 378282246310005",
    "+1 (202) 555-0123, +44 20 7946 0958 . +1 +22 333 4444 55 66 +1-2",
    "é\U0001F600 x@y.z \U0001F600+49 30 1234567",
    "", "no data here",
]


@pytest.mark.parametrize("text", CASES)
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_patterns_on_random_texts():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("01239.@+-() abé") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for run in ("1" * 400_000, "1." * 200_000, "a" * 400_000, "a@" * 200_000, "+" * 400_000, "1 " * 200_000, "+1" + "(" * 400_000):
        pii.base_spans(run)


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"ordinary words here number{k} and the Badger walks") for k in range(60)]
    out += [(100 + k, f"word{k} Zebulon agent reach me@spy.org today") for k in range(5)]  # Zebulon only near that address
    out += [(200 + k, f"the badger said call +49 30 1234567 in town{k}") for k in range(5)]  # badger is common
    return out + [(300, None), (301, ""), (None, "x@y.zz"), (100, out[60][1]), (100, out[60][1]), (302, ("plain " * 50_000) + "a@b.cc")]


def test_base_spans_stay_and_revealing_terms_are_added(spark, rows):
    got = pii.sanitise(docs(spark, rows, extra=("spans", "near")), keep=("doc_id", "text")).withColumn("clean", pii.redacted()).collect()
    assert len(got) == len(rows)
    terms = {}
    for r in got:
        text = r["text"] or ""
        spans = [(s["start"], s["kind"], s["end"]) for s in r["spans"]]
        assert [s for s in spans if s[1] < pii.BASE_KINDS] == brute(text)
        for start, kind, end in spans:
            if kind >= pii.BASE_KINDS:
                terms.setdefault(text[start:end].lower(), set()).add(pii.KINDS[kind])
    assert terms["zebulon"] == {"general"} and terms["agent"] == {"general"}  # five texts prove so much
    sure = pii.sanitise(docs(spark, rows), prior=0.0).filter("doc_id = 101").select("spans").first()[0]
    assert [s["kind"] for s in sure if s["kind"] >= pii.BASE_KINDS].count(pii.KINDS.index("removed")) >= 3
    assert "the" not in terms and "badger" not in terms and "word3" not in terms
    clean = next(r["clean"] for r in got if r["doc_id"] == 101)
    assert "[EMAIL]" in clean and "Zebulon" not in clean and "spy.org" not in clean
    assert next(r["clean"] for r in got if r["doc_id"] == 3) == rows[3][1]


def brute_disclosures(texts, generalise, remove, prior):
    """Terms by counting in sets of whole texts."""
    import math

    texts = set(texts)
    near, held, holds = {}, {}, {}
    for text in texts:
        spans = pii.base_spans(text or "")
        for word in {m.group().translate(pii._LOWER) for m in pii._TERM.finditer(text or "")}:
            holds.setdefault(word, set()).add(text)
        for entity, term, *_ in pii.contexts(text or "", spans):
            for e in (entity, entity.split(":")[0]):
                near.setdefault((e, term), set()).add(text)
        for s in spans:
            entity = pii._entity(text, s)
            for e in (entity, entity.split(":")[0]):
                held.setdefault(e, set()).add(text)
    out = {}
    for (e, term), both in near.items():
        share = len(held[e]) / len(texts)
        given = (len(both) + prior * share) / (len(holds[term]) + prior)
        revealed = math.log2(given / share) / math.log2(1 / share) if share < 1 else 0
        if revealed >= generalise:
            out[e, term] = pii.KINDS.index("removed" if revealed >= remove else "general")
    return out


def test_disclosures_are_those_of_counting(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta name street zip of the and".split()) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(n))
    rows = []
    for k in range(300):
        text = say(rng.randrange(2, 25))
        if rng.random() < 0.3:
            text += rng.choice([" call ", " mail ", " "]) + rng.choice([f"u{rng.randrange(20)}@spy.org", "+49 30 1234567", "10.0.0.7"]) + " " + say(4)
        rows += [(k, text)] * rng.choice([1, 1, 1, 3])
    rows += [(None, None), (900, ""), (901, None)]
    table = docs(spark, rows)
    found = pii._found(table, ["doc_id"])
    for generalise, remove, prior in ((0.7, 0.9, 3.0), (0.25, 0.4, 0.5)):
        got = {(r["entity"], r["term"]): r["kind"] for r in pii.disclosures(found, table, generalise, remove, prior).collect()}
        want = brute_disclosures([t for _, t in rows], generalise, remove, prior)
        assert got == want
    assert len(set(want.values())) == 2


def test_copies_of_a_text_reveal_no_more_than_one(spark):
    base = [(k, f"plain text number{k} of no interest") for k in range(300)]
    one = base + [(1000, "Zebulon reach me@spy.org today")]
    many = base + [(1000 + k, "Zebulon reach me@spy.org today") for k in range(9)]
    spans = [pii.sanitise(docs(spark, rows)).filter("doc_id = 1000").select("spans").first()[0] for rows in (one, many)]
    assert spans[0] == spans[1] and any(s["kind"] >= pii.BASE_KINDS for s in spans[0])


def test_digests_and_empty_table(spark):
    from pyspark.sql import functions as F

    table = pii.sanitise(docs(spark, [(1, "a@b.cc 1.2.3.4"), (2, None)])).select("doc_id", F.sha2(pii.spelled(F.col("spans")), 256).alias("h"), pii.count_of("ip").alias("n"))
    got = {r["doc_id"]: (r["h"], r["n"]) for r in table.collect()}
    assert got[1] == (hashlib.sha256(b"email:0:6,ip:7:14").hexdigest(), 1) and got[2] == (hashlib.sha256(b"").hexdigest(), 0)
    assert pii.sanitise(docs(spark, [])).count() == 0
