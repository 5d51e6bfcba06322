"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: email addresses, IP addresses, card and phone numbers. Words that stand near one
may give it away by themselves. How much a term t reveals of an entity e is estimated from the whole corpus: the share
PMI(t; e) / IC(e) of the entity's information, with document counts as probabilities (Sanchez and Batet, 2016). Terms
that reveal nearly all of it are removed next to the entity, terms that reveal much of it are generalised.

Entities are single values and their kinds: a rare name tells whose address it stands by, a word like "call" that a
number follows. P(e | t) is smoothed by some documents that hold e as often as the corpus does, so that few meetings
prove little. Equal texts are one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.llm.text import LETTER_DIGIT, map_batches, slices, word_hashes, words
from puspark.operators.joins import small_side
from puspark.sources.shared import materialise

KINDS = ("email", "ip", "card", "phone", "general", "removed")
BASE_KINDS = 4
#: Words on either side of an entity that may reveal it.
CONTEXT = 6
#: Documents of the corpus's average that every estimate counts besides those with the term.
PRIOR = 3.0
GENERALISE, REMOVE = 0.7, 0.9
LEAST_LENGTH = 3
#: Bits of the filter that tells which words of the corpus need counting; a broadcast of 1 MB at any size.
FILTER_BITS = 1 << 23

# Each pattern is anchored where a leftmost match can start only, so that long runs cost linear time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each domain that follows an @, the local characters before it that no match has taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        found = _AT.match(text, at)
        if found:
            start = at
            while start > taken and not _NOT_LOCAL.match(text, start - 1, start):
                start -= 1
            if start < at:
                yield start, found.end()
                taken = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in order."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.groups()]
            if all(len(p) < 4 and int(p or 0) < 256 for p in parts):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    value = text[span[0] : span[2]]
    return KINDS[span[1]] + ":" + (value.translate(_LOWER) if span[1] == 0 else value if span[1] == 1 else "".join(_DIGIT.findall(value)))


def _overlapped(spans: list[tuple[int, int, int]], at: int, start: int, end: int) -> bool:
    while at < len(spans) and spans[at][0] < end:
        if spans[at][2] > start:
            return True
        at += 1
    return False


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words near each span that overlap no span."""
    free = []
    at = 0
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        if not _overlapped(spans, at, m.start(), m.end()):
            free.append((m.start(), m.end()))
    starts = np.array([s for s, _ in free], np.int64)
    out = []
    for span in spans:
        middle = int(np.searchsorted(starts, span[0]))
        for start, end in free[max(0, middle - CONTEXT) : middle + CONTEXT]:
            if end - start >= LEAST_LENGTH:
                out.append((_entity(text, span), text[start:end].translate(_LOWER), start, end))
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
NEAR = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _found(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities, near = [], [], []
            for text in batch.column(len(keep)):
                text = text.as_py() or ""
                own = base_spans(text)
                spans.append([dict(zip(SPAN.names, s)) for s in own])
                entities.append(sorted({_entity(text, s) for s in own}))
                near.append([dict(zip(NEAR.names, c)) for c in contexts(text, own)] if own else [])
            out = [*batch.columns[: len(keep)], batch.column(len(keep) + 1), pa.array(spans, pa.list_(SPAN)), pa.array(entities, pa.list_(pa.string())), pa.array(near, pa.list_(NEAR))]
            yield pa.RecordBatch.from_arrays(out, [*keep, "text_key", "spans", "entities", "near"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = "text_key long, spans array<struct<start:int,kind:int,end:int>>, entities array<string>, near array<struct<entity:string,term:string,start:int,end:int>>"
    return map_batches(docs.select(*keep, F.col("text").alias("_text"), F.xxhash64("text")), run, f"{schema}, {added}")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_hashes(t, words(t, LETTER_DIGIT)) for t in slices(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["term", "term_hash"])


def _filled(terms: DataFrame) -> np.ndarray:
    """A filter of fixed size of the terms' hashes; tasks set its bits, in words of 64."""
    place = F.col("term_hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    one = F.expr("shiftleft(1L, cast(term_hash & 63 as int))")
    parts = terms.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in parts.toArrow().to_batches():  # at most FILTER_BITS / 64 rows
        filled[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return filled.view(np.uint64)


def document_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_hash, n_term): the sum of ``weight`` over the rows of ``texts`` (text, weight) that hold the word, for all of
    ``terms`` (term, term_hash) and some others.

    A filter of fixed size, made from the terms, says which words to count; tasks add up their own before the shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_filled(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        hashes, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            weight = batch.column(1).to_numpy()
            parts, weights = [hashes], [sums]
            for part in slices(batch.column(0)):
                found = words(part, LETTER_DIGIT)
                own = word_hashes(part, found)
                place = own & np.uint64(FILTER_BITS - 1)
                use = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                row, own = found.row[use], own[use]
                order = np.lexsort((own, row))
                row, own = row[order], own[order]
                fresh = np.ones(len(own), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1])
                parts.append(own[fresh])
                weights.append(weight[row[fresh] + part.first])
            every, at = np.unique(np.concatenate(parts), return_inverse=True)
            hashes, sums = every, np.zeros(len(every), np.int64)
            np.add.at(sums, at.ravel(), np.concatenate(weights))
            if len(hashes) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sums)], ["term_hash", "n"])
                hashes, sums = hashes[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sums)], ["term_hash", "n"])

    return map_batches(texts.select("text", "weight"), run, "term_hash long, n long").groupBy("term_hash").agg(F.sum("n").alias("n_term"))


def _counted_once(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, int]:
    """(text, weight) rows in which every distinct text weighs 1 in all, and the number of distinct texts.

    All rows weigh 1, and one row of every repeated text takes away what its copies are too many; only repeated texts
    are shuffled, and copies combine before it.
    """
    repeated = materialise(keys.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    more = repeated.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    rows = docs.select("text", F.lit(1).cast("long").alias("weight"))
    if more:
        copies = docs.select("text", F.xxhash64("text").alias("text_key")).join(small_side(repeated.select("text_key")), "text_key", "left_semi")
        copies = copies.groupBy("text_key").agg(F.any_value("text").alias("text")).join(repeated, "text_key")
        rows = rows.unionByName(copies.select("text", (1 - F.col("n")).alias("weight")))
    return rows, keys.count() - more


def disclosures(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR) -> DataFrame:
    """(entity, term, kind): terms that reveal ``generalise`` of an entity's information or more; ``remove`` sets kind.

    ``entity`` is ``kind:value`` or the kind alone. Ties with a threshold are above it.
    """
    of_kind = lambda entity: F.substring_index(entity, ":", 1)
    texts, n_texts = _counted_once(docs, found.select("text_key"))
    met = found.filter(F.size("near") > 0).select("text_key", F.explode("near").alias("c")).select("text_key", F.col("c.entity").alias("entity"), F.col("c.term").alias("term"))
    met = met.unionByName(met.withColumn("entity", of_kind(F.col("entity")))).distinct()
    pairs = materialise(met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")))
    held = found.filter(F.size("entities") > 0).select("text_key", F.explode("entities").alias("entity"))
    held = held.unionByName(held.withColumn("entity", of_kind(F.col("entity")))).distinct()
    holders = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    terms = materialise(map_batches(pairs.select("term").distinct(), _hashed, "term string, term_hash long"))
    counts = terms.join(document_counts(texts, terms), "term_hash").select("term", "n_term")
    n = F.lit(float(max(n_texts, 1)))
    share = F.col("n_entity") / n
    given = (F.col("n_both") + F.lit(prior) * share) / (F.col("n_term") + F.lit(prior))
    revealed = F.when(share < 1, F.log2(given / share) / F.log2(1 / share)).otherwise(0.0)
    judged = pairs.join(holders, "entity").join(materialise(counts), "term").withColumn("revealed", revealed).filter(F.col("revealed") >= generalise)
    kind = F.when(F.col("revealed") >= remove, KINDS.index("removed")).otherwise(KINDS.index("general"))
    return judged.select("entity", "term", kind.alias("kind"))


def sanitise(docs: DataFrame, keep: Sequence[str] = ("doc_id",), generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR) -> DataFrame:
    """``keep`` columns of every row of ``docs`` (with a column text), and its spans (start, kind, end) in order.

    Kinds are places in ``KINDS``; ends are exclusive, all in code points. Null and empty texts have no spans. Rows are
    judged one by one: null ids, repeated ids and repeated rows keep their own spans, and rows of one text count as one
    document. A column ``spans`` of ``keep`` is left out, all others stay. With ``text`` in ``keep``, ``redacted()``
    gives the clean text.
    """
    keep = [c for c in keep if c.lower() != "spans"]
    names = {c: f"keep_{i}" for i, c in enumerate(keep)}
    table = docs.select(*[F.col(c).alias(names[c]) for c in keep], "text")
    found = materialise(_found(table, list(names.values())).withColumn("row_no", F.monotonically_increasing_id()))
    bad = materialise(disclosures(found, table, generalise, remove, prior))
    near = found.filter(F.size("near") > 0).select("row_no", F.inline("near"))
    near = near.unionByName(near.withColumn("entity", F.substring_index("entity", ":", 1)))
    terms = near.join(bad, ["entity", "term"]).groupBy("row_no", "start", "end").agg(F.max("kind").alias("kind"))
    terms = terms.groupBy("row_no").agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))  # within one text
    spans = F.sort_array(F.concat("spans", F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return found.join(terms, "row_no", "left").select(*[F.col(names[c]).alias(c) for c in keep], spans.alias("spans"))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted() -> Column:
    """The text with every span replaced: entities by their kind, terms by nothing or by a word for any word."""
    marks = F.array(*[F.lit(m) for m in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "")])

    def step(a: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        fresh = F.struct(F.concat(a["done"], before, F.get(marks, s["kind"])).alias("done"), s["end"].alias("at"))
        inside = F.struct(a["done"].alias("done"), F.greatest(a["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(inside)

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    return F.aggregate("spans", start, step, lambda a: F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
