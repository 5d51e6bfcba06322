"""Words of UTF-8 texts as NumPy arrays: positions and hashes of all words of an Arrow column at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U64 = np.uint64
#: Bytes of text that are handled at a time, besides the rest of a longer document; arrays of a slice take some
#: hundred times this, so that many workers fit beside each other.
SLICE_BYTES = 1 << 17
#: Bytes of rows that Spark hands to a Python worker at a time, besides the rest of a longer row.
BATCH_BYTES = 4 << 20


def byte_class(lows: str) -> np.ndarray:
    """Table over bytes: true for the given ASCII characters and for every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in lows]] = True
    table[128:] = True
    return table


SPACES = " \t\n\v\f\r"
#: [^\x20\x09-\x0D]
NOT_SPACE = byte_class("".join(chr(c) for c in range(128) if chr(c) not in SPACES))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
LETTER_DIGIT = byte_class("0123456789abcdefghijklmnopqrstuvwxyz")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as in rows; the session's own bound stays if it is lower."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, "64m").lower().removesuffix("b").replace("m", "000000")) > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name.lower() in (c.lower() for c in columns):
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64 bits that spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1


def _series(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _series(BASE, 2 * SLICE_BYTES), _series(pow(BASE, -1, 1 << 64), 2 * SLICE_BYTES)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; those for slices of usual size are kept."""
    return _kept_powers() if n <= 2 * SLICE_BYTES else (_series(BASE, n), _series(pow(BASE, -1, 1 << 64), n))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every ``values[start:end]``, equal for equal contents wherever they stand."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.add(values, U64(1), out=sums[1:], casting="unsafe", dtype=U64)
    sums[1:] *= power[: len(values)]
    np.cumsum(sums, out=sums)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(BASE))


@dataclass
class Texts:
    """A slice of a text column: rows ``first`` to ``first + n`` as lower-cased bytes with row offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """A text column in slices of bounded bytes; whole texts, null as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        yield Texts(row, LOWER[part] if lower else part, offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    counts: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def words(texts: Texts, table: np.ndarray) -> Words:
    """Maximal runs of bytes of the class, never across rows."""
    inside = np.zeros(len(texts.data) + 2, bool)
    inside[1:-1] = table[texts.data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(texts.data))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    row = np.searchsorted(texts.offsets, starts, "right") - 1
    return Words(starts, np.flatnonzero(ends) + 1, row, np.bincount(row, minlength=texts.n))


def word_hashes(texts: Texts, found: Words) -> np.ndarray:
    return range_hashes(texts.data, found.starts, found.ends)


def char_offsets(texts: Texts) -> np.ndarray:
    """Code points before each byte of the slice, one entry more than bytes."""
    out = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=out[1:])
    return out
