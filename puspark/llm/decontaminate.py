"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's windows.

A shard is about a megabyte of whole texts inside a task. Words that occur in no benchmark item separate runs; runs too
short for any window are left out, as no window can lie in them. The rest is indexed: suffix array, Burrows-Wheeler
transform in a wavelet matrix, suffix positions sampled. All windows are searched at once by rank queries, located by
walking to the next sample, and merged into spans. The benchmark goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puspark.llm.text import LETTER_DIGIT, Texts, char_offsets, map_batches, slices, word_hashes, words
from puspark.sources.shared import materialise

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
RATIO = 20
#: Benchmark text per broadcast.
BLOCK_BYTES = 8 << 20
SAMPLE = 8
#: Text in one index.
SHARD_BYTES = 1 << 20


class WaveletMatrix:
    """Rank and access on a sequence of small integers: one bit vector with running counts per bit, highest first."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (values >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bits)))
            self.levels.append((shift, ones, len(values) - int(ones[-1])))
            values = np.concatenate((values[bits == 0], values[bits == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        begin = np.zeros_like(end)
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for _, ones, zeros in self.levels:
            bit = ones[at + 1] - ones[at]
            value = value * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return value


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By doubling. Every 0 is a separator of its own, so no comparison goes past it."""
    n = len(symbols)
    apart = int((symbols == 0).sum())
    keys, step = np.where(symbols == 0, np.cumsum(symbols == 0) - 1, symbols + apart), 1
    while True:
        order = np.argsort(keys, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(keys[order[1:]] != keys[order[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        keys = rank * (n + 1)
        keys[: n - step] += rank[step:] + 1
        step *= 2


class FMIndex:
    """Of a sequence of symbols, 0 as the last one and as separator."""

    def __init__(self, symbols: np.ndarray, top: int):
        suffixes = suffix_array(symbols)
        self.wavelet = WaveletMatrix(symbols[suffixes - 1], top)  # position -1 is the final separator
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        run_start = np.ones(len(symbols), bool)
        run_start[1:] = symbols[:-1] == 0
        self.sampled = ((suffixes % SAMPLE) == 0) | run_start[suffixes]
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = suffixes[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that start with each pattern (one row of symbols each, none of them 0)."""
        low, high = self.before[patterns[:, -1]], self.before[patterns[:, -1] + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            symbol = patterns[live, k]
            low, high = low.copy(), high.copy()
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            dead = np.ones(len(low), bool)
            dead[live] = False
            high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of every suffix: steps back to a sampled one. Run starts are sampled, so no walk leaves its run."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            at = open_[done]
            found[at] = self.samples[self.slot[rows[at]]] + steps[at]
            open_ = open_[~done]
            symbol = self.wavelet.access(rows[open_])
            rows[open_] = self.before[symbol] + self.wavelet.rank(symbol, rows[open_])
            steps[open_] += 1
        return found


@dataclass
class Windows:
    """The windows of a block of items, by length: one distinct window of symbols per row. The items of window k are the
    ``names`` at ``owners[starts[k]:starts[k + 1]]``."""

    vocabulary: np.ndarray
    patterns: list[np.ndarray]
    starts: list[np.ndarray]
    owners: list[np.ndarray]
    names: list[str]

    @property
    def shortest(self) -> int:
        return min(p.shape[1] for p in self.patterns)

    def items(self, length: int, k: int) -> list[str]:
        """Of window ``k`` of the ``length``-th list."""
        starts = self.starts[length]
        return [self.names[c] for c in self.owners[length][starts[k] : starts[k + 1]].tolist()]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix and the place of every row among them."""
    order = np.lexsort(rows.T[::-1])
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return rows[order[fresh]], place


def windows_of(items: Sequence[tuple[str | None, str | None]], length: int = WINDOW) -> Windows:
    """``length`` consecutive words each; an item of fewer, but not none, is one window. A null id counts as an empty one."""
    if not items:
        return Windows(np.zeros(0, np.uint64), [], [], [], [])
    hashes, counts = [], []
    for texts in slices(pa.array([t for _, t in items], pa.string())):
        found = words(texts, LETTER_DIGIT)
        hashes.append(word_hashes(texts, found))
        counts.append(found.counts)
    vocabulary, symbols = np.unique(np.concatenate(hashes), return_inverse=True)
    symbols = symbols.astype(np.int32) + 1
    count = np.concatenate(counts)
    first = np.cumsum(count) - count
    ids = ["" if item is None else str(item) for item, _ in items]
    names = sorted(set(ids))
    code_of = {name: k for k, name in enumerate(names)}
    code = np.array([code_of[i] for i in ids])
    out = Windows(vocabulary, [], [], [], names)
    size = np.minimum(count, length)
    for own in np.unique(size[size > 0]).tolist():
        some = np.flatnonzero(size == own)
        n = count[some] - own + 1
        item = np.repeat(some, n)
        start = np.arange(len(item)) + np.repeat(first[some] - (np.cumsum(n) - n), n)
        patterns, place = _distinct(symbols[start[:, None] + np.arange(own)])
        pairs = np.unique(place * len(names) + code[item])
        out.patterns.append(patterns)
        out.starts.append(np.searchsorted(pairs, np.arange(len(patterns) + 1) * len(names)).astype(np.int32))
        out.owners.append((pairs % len(names)).astype(np.int32))
    return out


def _occurrences(index: FMIndex, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = index.search(patterns)
    which = np.repeat(np.arange(len(patterns)), high - low)
    first = np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low)
    return which, index.locate(first + np.arange(len(which)))


def hits(texts: Texts, windows: Windows) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int, int]]], dict[int, set[str]]]:
    """Words per text; by text its hit runs (first and end word, first and end code point), and its items."""
    found = words(texts, LETTER_DIGIT)
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    items: dict[int, set[str]] = {}
    if not windows.patterns or not len(found.starts):
        return found.counts, spans, items
    hashes = word_hashes(texts, found)
    symbol = np.searchsorted(windows.vocabulary, hashes)
    symbol[symbol == len(windows.vocabulary)] = 0
    known = windows.vocabulary[symbol] == hashes
    breaks = np.ones(len(known) + 1, bool)  # where a run of known words of one text starts or ends
    breaks[1:-1] = (known[1:] != known[:-1]) | (found.row[1:] != found.row[:-1])
    edges = np.flatnonzero(breaks)
    starts, lengths = edges[:-1], np.diff(edges)
    use = known[starts] & (lengths >= windows.shortest)
    starts, lengths = starts[use], lengths[use]
    if not len(starts):
        return found.counts, spans, items
    total = int(lengths.sum()) + len(lengths)
    offset = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    word = np.arange(total) + np.repeat(starts - offset, lengths + 1)  # of each place in the index
    apart = offset + lengths
    word[apart] -= 1
    symbols = symbol[word] + 1
    symbols[apart] = 0
    index = FMIndex(symbols, len(windows.vocabulary))
    cover = np.zeros(len(known) + 1, np.int64)
    for length, patterns in enumerate(windows.patterns):
        which, place = _occurrences(index, patterns)
        first = word[place]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + patterns.shape[1], -1)
        pairs = np.unique(found.row[first] * len(patterns) + which)
        for pair in pairs.tolist():
            items.setdefault(pair // len(patterns), set()).update(windows.items(length, pair % len(patterns)))
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.ones(len(hit) + 1, bool)
    edge[1:-1] = (hit[1:] != hit[:-1]) | (found.row[1:] != found.row[:-1])
    edges = np.flatnonzero(edge)
    chars, first_word = char_offsets(texts), found.firsts
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hit[a]:
            row = int(found.row[a])
            zero = chars[texts.offsets[row]]
            spans.setdefault(row, []).append((a - int(first_word[row]), b - int(first_word[row]), int(chars[found.starts[a]] - zero), int(chars[found.ends[b - 1]] - zero)))
    return found.counts, spans, items


def merged(one: list[tuple], other: list[tuple]) -> list[tuple]:
    """Union of two lists of runs; runs that touch become one."""
    out: list[tuple] = []
    for run in sorted([*one, *other]):
        if out and run[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], run[1]), last[2], max(last[3], run[3]))
        else:
            out.append(tuple(run))
    return out


SPAN = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(rows: DataFrame, shared: Broadcast[Windows]) -> DataFrame:
    """Adds one block's hits to ``rows``, whose last four columns are text, n_words, spans and items."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, old_spans, old_items = batch.columns[-4:]
            old_spans, old_items = old_spans.to_pylist(), old_items.to_pylist()
            counts, spans, items = [], [], []
            for texts in slices(text, size=SHARD_BYTES):
                n, found, owners = hits(texts, shared.value)
                counts.append(n)
                for k in range(texts.n):
                    at = texts.first + k
                    spans.append([dict(zip(SPAN.names, s)) for s in merged([tuple(s.values()) for s in old_spans[at]], found.get(k, []))])
                    items.append(sorted({*old_items[at], *owners.get(k, ())}))
            n_words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], n_words, pa.array(spans, pa.list_(SPAN)), pa.array(items, pa.list_(pa.string()))], names)

    return map_batches(rows, run, rows.schema)


def scan(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns and text of every row of ``docs``, with n_words, spans (word and code-point ranges) and items.

    ``items`` are the ids, as strings in order, of the items with a window in the text. Null and empty texts have no
    words and no hits, as have all texts if the benchmark is empty; repeated items count once, one id with several
    texts has the windows of all. Columns that clash with those added are replaced.
    """
    added = {"text", "n_words", "spans", "items"}
    rows = docs.select(*[c for c in keep if c not in added], "text").withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "spans": F.array().cast("array<struct<first_word:int,end_word:int,start:int,end:int>>"),
            "items": F.array().cast("array<string>"),
        }
    )
    bench = materialise(benchmark.select("item_id", "text").distinct())
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        own = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        windows = docs.sparkSession.sparkContext.broadcast(windows_of([tuple(r) for r in own.toLocalIterator()]))
        rows = _scan(rows, windows)
        if k + 1 < blocks:  # one block's windows at a time, however large the benchmark
            rows = materialise(rows)
            windows.destroy()
    return rows


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])


def is_contaminated() -> Column:
    return (n_hit() > 0) & (RATIO * n_hit() >= F.col("n_words"))


def without_spans() -> Column:
    """The text with its spans taken out."""
    rest = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])).alias("done"), s["end"].alias("at")),
        lambda a: F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    return F.when(F.size("spans") > 0, rest).otherwise(F.col("text"))
