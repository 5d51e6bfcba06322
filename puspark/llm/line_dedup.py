"""Line dedup by winnowing over line hashes.

Lines without words are passed over; other lines are compared without the white space around them. A window is the
shortest run of lines from a line on, or back from it, that has 50 words. The least line hash of each window is its
fingerprint, so any repeated run of 50 words shares a fingerprint with its first occurrence, whatever stands around
it. Positions are joined on fingerprints that occur twice, then on the contents of the windows they stand for; windows
that match follow each other line by line to both sides and cover the whole run. Later runs are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from puspark.llm.text import NOT_SPACE, Texts, map_batches, range_hashes, slices, words
from puspark.sources.shared import materialise

WORDS = 50
_SPACES = " \t\n\v\f\r"


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, words) of every line with words, in order."""
    found = words(texts, NOT_SPACE)
    breaks = np.concatenate(([0], np.cumsum(texts.data == 10)))[found.starts]
    fresh = np.ones(len(breaks), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (found.row[1:] != found.row[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(breaks)) - 1 if len(first) else first
    return found.row[first], range_hashes(texts.data, found.starts[first], found.ends[last]), last - first + 1


def windows(row: np.ndarray, hashes: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and place of the least hash of every window, first and last ascending."""
    n = len(row)
    ends = np.cumsum(size)
    begins = ends - size
    last = np.searchsorted(ends, begins + least)
    first = np.searchsorted(begins, ends - least, "right") - 1
    at = np.arange(n)
    ahead = (last < n) & (row[np.minimum(last, n - 1)] == row) if n else np.zeros(0, bool)
    back = (first >= 0) & (row[np.maximum(first, 0)] == row) if n else np.zeros(0, bool)
    both = np.unique(np.column_stack((np.concatenate((at[ahead], first[back])), np.concatenate((last[ahead], at[back])))), axis=0)
    first, last = both[:, 0], both[:, 1]
    place = first.copy()
    for step in range(1, int((last - first).max(initial=0)) + 1):
        live = np.flatnonzero(first + step <= last)
        other = first[live] + step
        better = hashes[other] <= hashes[place[live]]
        place[live[better]] = other[better]
    return first, last, place


WINDOW = pa.struct([("mark", pa.int64()), ("content", pa.int64()), ("first_line", pa.int32()), ("last_line", pa.int32())])
WINDOW_SQL = "struct<mark:bigint,content:bigint,first_line:int,last_line:int>"


def fingerprinted(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_key, n_lines, windows, marks) of every row; marks are the selected lines' hashes, once per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2), lower=False):
                row, hashes, size = lines(texts)
                first, last, place = windows(row, hashes, size, least)
                content = range_hashes(hashes, first, last + 1).view(np.int64)
                counts = np.bincount(row, minlength=texts.n)
                zero = (np.cumsum(counts) - counts)[row]
                of_row = np.searchsorted(row[first], np.arange(texts.n + 1)).astype(np.int32) if len(first) else np.zeros(texts.n + 1, np.int32)
                numbers = [(x - zero[first]).astype(np.int32) for x in (first, last)]
                found = pa.StructArray.from_arrays([pa.array(hashes[place].view(np.int64)), pa.array(content), *map(pa.array, numbers)], fields=list(WINDOW))
                chosen = np.unique(place)
                mark_rows = np.searchsorted(row[chosen], np.arange(texts.n + 1)).astype(np.int32) if len(chosen) else np.zeros(texts.n + 1, np.int32)
                out = [
                    batch.column(0).slice(texts.first, texts.n),
                    batch.column(1).slice(texts.first, texts.n),
                    pa.array(counts.astype(np.int32)),
                    pa.ListArray.from_arrays(of_row, found),
                    pa.ListArray.from_arrays(mark_rows, pa.array(hashes[chosen].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_key", "n_lines", "windows", "marks"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n_lines int, windows array<{WINDOW_SQL}>, marks array<bigint>"
    return map_batches(docs.select("doc_id", _text_key(), "text"), run, schema)


def _text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def repeated_runs(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """(doc_id, text_key, runs): by document the line ranges that repeat an earlier run, as an array of structs.

    A match is extended from a shared fingerprint in both directions at once: every shortest run of ``least`` words that
    holds the fingerprint's line is compared by the hash of all its lines. Equal ones are a match of that length, and a
    longer match is the union of the overlapping ones it consists of. So no pairs of positions are made, of which a
    line that many documents share has the square.

    Earlier is by doc_id (null last), then by text, then by line; within one document a run repeats another only if
    they do not overlap. Rows that agree in doc_id and text are one document.
    """
    found = materialise(fingerprinted(docs, least))
    shared = found.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    shared = materialise(shared)  # so that the join shuffles both sides for itself, and skew can be split
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "first_line", "last_line")
    near = materialise(found.select("doc_id", "text_key", F.inline("windows")).join(shared, "mark", "left_semi"))
    firsts = near.groupBy("content").agg(F.min(order).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = materialise(firsts)
    own = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("text_key") == F.col("origin.text_key"))
    later = near.join(firsts, "content").filter(~own | (F.col("first_line") > F.col("origin.last_line")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first_line", "last_line")).alias("runs"))  # within one text


def without_lines(text: str, gone: set[int]) -> str:
    kept, number = [], 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            number += 1
            if number - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept)


def dedup_lines(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any columns), its text without the lines of runs of ``least`` words or more
    that an earlier document, or the document itself before, has too; ``n_removed`` is their number.

    Null texts stay null and empty ones empty; a text whose lines all go becomes what is left of its blank lines. Rows
    that agree in doc_id and text are one document and keep the same lines. No row is dropped. A column ``n_removed``
    of ``docs`` is replaced.
    """
    docs = docs.drop("n_removed")
    runs = repeated_runs(docs.select("doc_id", "text"), least).toDF("_dedup_id", "_dedup_key", "_dedup_runs")
    rows = docs.join(runs, F.col("doc_id").eqNullSafe(F.col("_dedup_id")) & (F.xxhash64("text") == F.col("_dedup_key")), "left")
    rows = rows.select(*docs.columns, "_dedup_runs")
    at, names = docs.columns.index("text"), [*docs.columns, "n_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(at), []
            changed: dict[int, str] = {}
            for k, own in enumerate(batch.column(batch.num_columns - 1)):
                gone = {n for r in own.as_py() or () for n in range(r["first_line"], r["last_line"] + 1)}
                removed.append(len(gone))
                if gone:
                    changed[k] = without_lines(texts[k].as_py(), gone)
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(changed.values()), texts.type))
            columns = [texts if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int32())], names)

    return map_batches(rows, run, T.StructType([*docs.schema, T.StructField("n_removed", T.IntegerType())]))
