"""Language ID: multinomial naive Bayes over hashed character n-grams.

Every task counts its labelled texts' n-grams per language and bucket; Spark adds the counts up. The matrix of
log-probabilities (languages x buckets) is broadcast; each batch of texts is scored by gathering the matrix rows of
its n-grams and summing them per text. Runs of characters that are not letters count as one separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.llm.text import Texts, char_offsets, map_batches, mix, slices
from puspark.sources.shared import materialise

BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
#: Languages whose log-probabilities are broadcast at a time: 32 MB.
LANGUAGES = 250
SLICE = 1 << 17
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams that hold a letter, rows ascending within each n, and whether each row has a letter."""
    codes = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = char_offsets(texts)[texts.offsets]
    row = np.repeat(np.arange(texts.n), np.diff(first))
    letter = _letters()[codes]
    keep = letter.copy()  # of a run of other characters the first stays
    keep[:1] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    codes, row, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), row[keep], letter[keep]
    rows, buckets = [], []
    for n in GRAMS:
        size = max(0, len(codes) - n + 1)
        value, some = np.full(size, n, np.uint64), np.zeros(size, bool)
        for k in range(n):
            value = (value << np.uint64(21)) | codes[k : k + size]
            some |= letter[k : k + size]
        some &= row[:size] == row[n - 1 : n - 1 + size]
        rows.append(row[:size][some])
        buckets.append((mix(value[some]) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets), np.bincount(row[letter], minlength=texts.n) > 0


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are not learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` with a language; bucket -1 counts texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for texts in slices(batch.column(0), size=SLICE):
                row, bucket, some = grams(texts)
                own = langs[texts.first : texts.first + texts.n]
                names = sorted(set(own))
                code = np.searchsorted(names, own)
                found = np.bincount(code[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums = total.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    sums[1:] += found[k]
                    sums[0] += int(some[code == k].sum())
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at - 1), pa.array(sums[at])], ["lang", "bucket", "n"])

    own = docs.filter("lang is not null and text is not null").select("text", "lang")
    return map_batches(own, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages by code point, the counts that ``counts`` made, and the learned texts' number."""

    langs: list[str]
    table: DataFrame
    n_texts: int

    def block(self, first: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages from number ``first`` on, their log-probabilities (buckets x languages) and log-priors."""
        langs = self.langs[first : first + LANGUAGES]
        place = {lang: k for k, lang in enumerate(langs)}
        logs, prior = np.full((BUCKETS, len(langs)), SMOOTHING), np.ones(len(langs))
        for row in self.table.filter(F.col("lang").between(langs[0], langs[-1])).toLocalIterator():  # LANGUAGES x (BUCKETS + 1) at most
            if row["lang"] in place and row["bucket"] >= 0:
                logs[row["bucket"], place[row["lang"]]] += row["n"]
            elif row["lang"] in place:
                prior[place[row["lang"]]] = row["n"]
        return langs, np.log(logs / logs.sum(axis=0)), np.log(prior / self.n_texts)


def fit(docs: DataFrame) -> Model:
    """Learned from the rows of ``docs`` with a language and a text with a letter; there may be any number of languages."""
    table = materialise(counts(docs))
    texts = table.filter("bucket = -1").select("lang", "n").collect()  # one row per language
    return Model(sorted(r["lang"] for r in texts), table, sum(r["n"] for r in texts))


def _scored(rows: DataFrame, block: Broadcast, keep: int) -> DataFrame:
    """``rows`` (kept columns, text, lang_pred, log, whole) with a block of languages taken in: the best so far, its log
    likelihood, and that of all so far together."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, prior = block.value
        for batch in batches:
            best, log, whole = np.array(batch.column(keep + 1).to_pylist(), object), batch.column(keep + 2).to_numpy().copy(), batch.column(keep + 3).to_numpy().copy()
            for texts in slices(batch.column(keep), size=SLICE):
                row, bucket, some = grams(texts)
                like = np.column_stack([np.bincount(row, weights=logs[:, k][bucket], minlength=texts.n) for k in range(len(langs))]) + prior
                top, own = like.argmax(axis=1), slice(texts.first, texts.first + texts.n)
                most = like[np.arange(texts.n), top]
                whole[own] = np.where(some, np.logaddexp(whole[own], most + np.log(np.exp(like - most[:, None]).sum(axis=1))), whole[own])
                better = some & (most > log[own])
                best[own] = np.where(better, np.array(langs, object)[top], best[own])
                log[own] = np.where(better, most, log[own])
            yield pa.RecordBatch.from_arrays([*batch.columns[: keep + 1], pa.array(best, pa.string()), pa.array(log), pa.array(whole)], names)

    return map_batches(rows, run, rows.schema)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and its posterior probability ``score``, for every row.

    Texts that are null or have no letter get ``und`` with score 0, as do all if nothing was learned; equal
    probabilities give the first language by code point. Repeated rows are judged alike; ``keep`` may not hold
    ``lang_pred`` or ``score``. Languages are broadcast in blocks of ``LANGUAGES``, one block at a time.
    """
    if clash := [c for c in keep if c.lower() in ("lang_pred", "score")]:
        raise ValueError(f"columns {clash} have names of results")
    none = F.lit(float("-inf"))
    rows = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))
    rows = rows.withColumns({"lang_pred": F.lit(None).cast("string"), "log": none, "whole": none})
    for first in range(0, len(model.langs), LANGUAGES):
        block = docs.sparkSession.sparkContext.broadcast(model.block(first))
        rows = _scored(rows, block, len(keep))
        if first + LANGUAGES < len(model.langs):
            rows = materialise(rows)
            block.destroy()
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.exp(F.col("log") - F.col("whole")))
    return rows.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))
