"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian with its own covariance, shrunk towards the pooled one and towards a sphere (Friedman, 1989).
One pass measures every whole text; class sums and cross products are added up by Spark, so all labelled rows count;
the driver gets one d x d matrix per class and factors it once. A score is the logistic of the difference of the two
log densities, each a Mahalanobis distance through its cached Cholesky factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.llm.text import NOT_SPACE, SLICE_BYTES, Texts, map_batches, mix, range_hashes, slices, word_hashes, words

#: Share of the pooled covariance in a class's, and of the sphere in the result.
POOLED, SPHERE = 0.1, 0.02
MEASURES = (
    "words", "lines", "word_length", "length_spread", "long_words", "short_words", "distinct_words", "same_as_last",
    "repeated_lines", "capitals", "digits", "stops", "exclamations", "marks", "bars", "word_ends_odd",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_UPPER | _DIGIT | _STOP)
_MARK[97:123] = False
_MARK[[ord("!"), ord("|")]] = False
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _per_row(texts: Texts, table: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(table[texts.data])))
    return sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[first], minlength=n)


def measures(texts: Texts) -> np.ndarray:
    """Transformed statistics, one row per text: logarithms of counts, logits of shares. All are drawn to usual values by
    some ten words or fifty characters, so that short texts are no outliers."""
    n = texts.n
    found = words(texts, NOT_SPACE)
    hashes = word_hashes(texts, found)
    lines = words(texts, ~_NEWLINE)
    line_hashes = range_hashes(texts.data, lines.starts, lines.ends)
    count, size = found.counts, np.diff(texts.offsets)
    starts = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
    length = (starts[found.ends] - starts[found.starts]).astype(float)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(found.row, weights=values, minlength=n)

    def share(part: np.ndarray, whole: np.ndarray, usual: float = 0.02, prior: float = 10.0) -> np.ndarray:
        p = (part + usual * prior) / (whole + prior)
        return np.log(p / (1 - np.minimum(p, 1 - 1e-6)))

    mean = (total(length) + 50) / (count + 10)
    spread = np.sqrt(np.maximum((total(length**2) + 340) / (count + 10) - mean**2, 0))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (found.row[1:] == found.row[:-1])
    tail = texts.data[found.ends - 1] if len(hashes) else np.zeros(0, np.uint8)
    odd = _MARK[tail] | (tail == ord("!"))
    return np.column_stack(
        (
            np.log(count + 20),
            np.log(lines.counts + 5),
            np.log1p(mean),
            np.log1p(spread),
            share(total(length > 12), count, 0.05),
            share(total(length < 4), count, 0.4),
            share(_distinct(found.row, hashes, n), count, 0.8),
            share(total(same), count),
            share(lines.counts - _distinct(lines.row, line_hashes, n), lines.counts),
            share(_per_row(texts, _UPPER), size, 0.02, 50),
            share(_per_row(texts, _DIGIT), size, 0.005, 50),
            share(_per_row(texts, _STOP), size, 0.02, 50),
            share(_per_row(texts, texts_table("!")), size, 0.002, 50),
            share(_per_row(texts, _MARK), size, 0.002, 50),
            share(_per_row(texts, texts_table("|")), size, 0.002, 50),
            share(total(odd), count),
        )
    )


def texts_table(char: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord(char)] = True
    return table


def _matrix(column: pa.Array, size: int = SLICE_BYTES) -> np.ndarray:
    parts = [measures(t) for t in slices(column, lower=False, size=size)]
    return np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row: its statistics; null and empty texts have those of a text without words.

    Texts of any length are measured whole, repeated rows alike, each by itself; null ids stay null. Other columns are
    not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(MEASURES), x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "x"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    """Cholesky factors of both classes. Without rows of both classes nothing is known and every score is one half."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        logs = []
        for prior, mean, factor in zip(self.log_prior, self.means, self.factors):
            y = np.linalg.solve(factor, (z - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def learned_rows(doc_id: Column | str = "doc_id") -> Column:
    """Labels may be learned from these rows only; a null id counts as an empty text."""
    return held_out_rest(doc_id) != 1


def held_out_rest(doc_id: Column | str) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 3


def fit(x: DataFrame, labels: DataFrame) -> Discriminant:
    """From ``measured`` rows and labels (doc_id, quality 0/1) of the rows that may be learned from.

    Every label row counts once per document row with its id, conflicting ones too; null labels and ids count nowhere.
    """
    d = len(MEASURES)
    labels = labels.filter("quality in (0, 1)").filter(learned_rows()).select("doc_id", F.col("quality").cast("int").alias("quality"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = rows[label == c]
                total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at // total.shape[1]), pa.array(at % total.shape[1]), pa.array(total.ravel())], ["c", "i", "v"])

    pairs = x.join(labels, "doc_id").select("quality", "x")
    parts = pairs.mapInArrow(sums, "c long, i long, v double").groupBy("c", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for row in parts.collect():  # 2 (1 + d + d^2) numbers, whatever the size of the tables
        total[row["c"], row["i"]] = row["v"]
    n = total[:, 0]
    if not n.all():
        return Discriminant(np.zeros(d), np.ones(d), np.zeros(2), [], [])
    centre = total[:, 1 : 1 + d].sum(axis=0) / n.sum()
    means = total[:, 1 : 1 + d] / n[:, None]
    spread = [total[c, 1 + d :].reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    scale = np.sqrt(np.maximum(np.diag(spread[0] + spread[1]) / n.sum(), 1e-6))
    spread = [s / np.outer(scale, scale) for s in spread]
    pooled = (spread[0] + spread[1]) / n.sum()
    factors = []
    for c in (0, 1):
        own = (1 - POOLED) * spread[c] / n[c] + POOLED * pooled
        own = (1 - SPHERE) * own + SPHERE * max(np.trace(own) / d, 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky(own))
    return Discriminant(centre, scale, np.log(n / n.sum()), [(m - centre) / scale for m in means], factors)


def scored(x: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of ``measured`` rows: 0 to 1, higher where label 1 is likelier.

    Rows of equal statistics, repeated ones among them, have equal scores; without a fitted class all are one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], ["doc_id", "score"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Discriminant, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, all columns as they are, whatever their names. No text is
    shuffled.

    A score of exactly ``least`` is accepted; null and empty texts are scored as texts without words; repeated rows are
    kept or dropped together.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(_matrix(batch.column(at))) >= least))

    return map_batches(docs, run, docs.schema)
