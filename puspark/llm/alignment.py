"""Alignment of two tokenizers' tokens over the same bytes.

Incidence matrices of tokens and bytes are held as compressed rows made by hand: a row of A names the bytes of one
token, a row of B transposed names the token that holds one byte. Gustavson's product adds up, for every row of A, the
rows of B transposed that it names; its entries are the links, and their values the bytes that two tokens share. Offsets
where tokens of both end cut a text into groups; the product of the incidences of tokens and groups links all tokens of
one group.

How often an id pair is linked is counted over the corpus. Documents are held in blocks of a bounded number of links,
each with its distinct pairs, so that counts are fetched per block and pair instead of per link: a pair's rows are as
many as there are blocks, and no task gets more than one block at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puspark.llm.bpe import WHITE_SPACE, Merges, Offsets, byte_symbols, differs
from puspark.llm.text import map_batches, slices
from puspark.sources.shared import materialise

# Fixed value: the words of byte-level vocabularies.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of such a length take the faster library a time that is quadratic in it.
LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{300}}|[^{WHITE_SPACE}]{{300}}")
#: Links of a block, besides the rest of a longer document.
BLOCK_LINKS = 1 << 22
#: Links of tokens of one group that are made at a time.
GROUP_LINKS = 1 << 20


@dataclass
class Rows:
    """An incidence matrix in compressed rows: row i names the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def transposed(self, n_columns: int) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        return Rows(_starts(np.bincount(self.columns, minlength=n_columns)), np.repeat(np.arange(len(self.starts) - 1), self.sizes)[order])

    def part(self, first: int, last: int) -> Rows:
        own = self.starts[first : last + 1]
        return Rows(own - own[0], self.columns[own[0] : own[-1]])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of a·b by Gustavson's algorithm, by row and column."""
    size = b.sizes[a.columns]
    at = np.arange(size.sum()) + np.repeat(b.starts[a.columns] - (np.cumsum(size) - size), size)
    row = np.repeat(np.repeat(np.arange(len(a.starts) - 1), a.sizes), size)
    column = b.columns[at]
    # each row's accumulator: equal columns side by side
    back = (row[1:] == row[:-1]) & (column[1:] < column[:-1])
    if back.any():
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
    fresh = np.ones(len(row) + 1, bool)
    fresh[1:-1] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    first = np.flatnonzero(fresh)
    return row[first[:-1]], column[first[:-1]], np.diff(first)


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, file_a: str, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a, self.b = Tokenizer.from_str(file_a), sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.a.encode_special_tokens = True
        file, byte = json.loads(file_a), {c: b for b, c in enumerate(byte_symbols())}
        self.fast = _by_rank(file, byte)
        self.settled: set[str] = set()
        names = {**file["model"]["vocab"], **{t["content"]: t["id"] for t in file["added_tokens"]}}
        bytes_a = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            bytes_a[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = Offsets(bytes_a), Offsets(bytes_b)
        self.n_a, self.n_b = len(bytes_a), len(bytes_b)
        most = max(self.n_a, self.n_b)
        #: Decimal ids followed by a comma, a bar or a semicolon.
        self.decimals = Offsets([f"{i}{mark}".encode() for mark in ",|;" for i in range(most)])
        self.most = most


    def encode_a(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of A; texts that the faster library may read otherwise, or slowly, go to the file's own one."""
        out, rest = [], []
        for text in texts:
            if self.fast is None or LONG_RUN.search(text) or not (text.isascii() or self._settled(text)):
                rest.append(len(out))
                out.append(None)
            else:
                out.append(self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64))
        for i, found in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = np.asarray(found.ids, np.int64)
        return out

    def _settled(self, text: str) -> bool:
        fresh = set(text) - self.settled
        if any(map(differs, fresh)):
            return False
        self.settled |= fresh
        return True


def _by_rank(file: dict, byte: dict[str, int]):
    """The vocabulary for the library that merges any pair whose bytes are a token, by id; None where that may differ.

    If merging by rank makes every token of its own bytes, then a pair of tokens with a token's bytes is always the pair
    it was made of, and both libraries merge alike.
    """
    import tiktoken

    model, split = file["model"], file["pre_tokenizer"]
    merges = Merges(list(byte), [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
    ids = [model["vocab"].get(s, -1) for s in merges.spelled]
    plain = file["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    in_order = min(ids) >= 0 and max(ids[:256]) < ids[256] and all(a < b for a, b in zip(ids[256:], ids[257:]))
    if not (plain and in_order and len(merges.number) == len(merges.spelled)):
        return None
    ranks = {bytes(byte[c] for c in s): i for s, i in zip(merges.spelled, ids)}
    return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


@cache
def _tokenizers(file_a: str, model_b: bytes) -> Tokenizers:
    return Tokenizers(file_a, model_b)


@dataclass
class Aligned:
    """Texts one after another: ids with the text, first byte and group of every token of each side."""

    n: int
    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    text_group: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, shared bytes) of all overlaps, by A token."""
        size = int(self.starts_a[-1])
        tokens_of_b = Rows(self.starts_b, np.arange(size))
        return product(Rows(self.starts_a, np.arange(size)), tokens_of_b.transposed(size))

    def _groups(self) -> tuple[Rows, Rows]:
        n = len(self.text_group)
        a = Rows(np.arange(len(self.a) + 1), self.group_a)
        return a, Rows(np.arange(len(self.b) + 1), self.group_b).transposed(n)

    def n_shared(self) -> np.ndarray:
        """Links of tokens of one group, per text: sizes of the product's rows, without making them."""
        a, b = self._groups()
        return np.bincount(self.text_a, weights=b.sizes[a.columns], minlength=self.n).astype(np.int64)

    def shared(self, at_a_time: int = GROUP_LINKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A token, B token) of all pairs of one group, a bounded number of A's rows at a time."""
        a, b = self._groups()
        ends, first = np.cumsum(b.sizes[a.columns]), 0
        while first < len(self.a):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + at_a_time, "right")))
            row, column, _ = product(a.part(first, last), b)
            yield row + first, column
            first = last

    def spelled(self, decimals: Offsets, most: int) -> list[bytes]:
        """Groups of every text as ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = np.bincount(self.group_a, minlength=len(self.text_group)), np.bincount(self.group_b, minlength=len(self.text_group))
        entry = np.empty(len(self.a) + len(self.b), np.int64)
        entry[np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[self.group_a]] = self.a
        entry[np.arange(len(self.b)) + np.cumsum(n_a)[self.group_b]] = self.b
        ends = np.cumsum(n_a + n_b)
        entry[ends - n_b - 1] += most
        entry[ends - 1] += 2 * most
        data = decimals.spell(entry)
        text = np.repeat(self.text_group, n_a + n_b)
        ends = np.cumsum(np.bincount(text, weights=decimals.sizes[entry], minlength=self.n).astype(np.int64))
        begins = np.concatenate(([0], ends[:-1]))
        return [data[s : e - 1].tobytes() if e > s else b"" for s, e in zip(begins.tolist(), ends.tolist())]


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in lists if len(x)]])
    return flat, np.repeat(np.arange(len(lists)), sizes)


def align_texts(both: Tokenizers, texts: Sequence[str | None]) -> Aligned:
    """Texts that are null or empty, or that a side does not give back byte by byte, have no tokens."""
    some = [i for i, t in enumerate(texts) if t]
    ids_a: list[Sequence[int]] = [()] * len(texts)
    ids_b: list[Sequence[int]] = [()] * len(texts)
    spaced = [" " + texts[i] for i in some]
    found = both.encode_a(spaced)
    pieces = both.b.encode([texts[i] for i in some], num_threads=1) if some else []
    for i, text, x, y in zip(some, spaced, found, pieces):
        raw, y = text.encode(), np.asarray(y, np.int64)
        if both.bytes_a.spell(x).tobytes() == raw and both.bytes_b.spell(y).tobytes() == raw:
            ids_a[i], ids_b[i] = x, y
    a, text_a = _flat(ids_a)
    b, text_b = _flat(ids_b)
    starts_a, starts_b = _starts(both.bytes_a.sizes[a]), _starts(both.bytes_b.sizes[b])
    common = np.intersect1d(starts_a[1:], starts_b[1:], assume_unique=True)
    group_a, group_b = np.searchsorted(common, starts_a[1:]), np.searchsorted(common, starts_b[1:])
    text_group = np.zeros(len(common), np.int64)
    text_group[group_a] = text_a
    return Aligned(len(texts), a, b, text_a, text_b, starts_a, starts_b, group_a, group_b, text_group)


def _shared_files(docs: DataFrame, path_a: str, path_b: str):
    """Both files, as one broadcast of their bytes: a fixed size, whatever the texts."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _clear(keep: Sequence[str], names: Sequence[str]) -> None:
    if clash := [c for c in keep if c.lower() in names]:
        raise ValueError(f"columns {clash} have names of results")


def links(docs: DataFrame, path_a: str, path_b: str, keep: Sequence[str] = ("doc_id",), grouped: bool = False) -> DataFrame:
    """``keep`` columns and a_at, b_at (places of tokens in the text, from 0), a_id, b_id and shared_bytes of every link.

    Links are overlaps; with ``grouped``, all pairs of tokens of one group, with shared_bytes null. Documents without
    tokens (null, empty, or not given back by a side) have no rows; repeated rows have their links each. ``keep`` may
    not hold a result's name; an empty table gives an empty result.
    """
    names = ("a_at", "b_at", "a_id", "b_id", "shared_bytes")
    _clear(keep, names)
    files = _shared_files(docs, path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*files.value)
        for batch in batches:
            column = batch.column(len(keep))
            for part in slices(column, lower=False):
                found = align_texts(both, column.slice(part.first, part.n).to_pylist())
                first_a = np.searchsorted(found.text_a, np.arange(found.n))
                first_b = np.searchsorted(found.text_b, np.arange(found.n))
                made = ((i, j, None) for i, j in found.shared()) if grouped else (found.links(),)
                for i, j, shared in made:
                    text = found.text_a[i]
                    at = pa.array(text + part.first)
                    size = pa.nulls(len(i), pa.int64()) if shared is None else pa.array(shared, pa.int64())
                    numbers = [pa.array(x) for x in (i - first_a[text], j - first_b[text], found.a[i], found.b[j])]
                    yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[: len(keep)]], *numbers, size], [*keep, *names])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{n} long" for n in names]])
    return map_batches(docs.select(*keep, "text"), run, schema)


class _Block:
    """Documents of a task until their links fill a block."""

    def __init__(self, keep: Sequence[str], n_b: int):
        self.keep, self.n_b = keep, n_b
        self.kept, self.counts, self.digests, self.codes, self.sizes, self.held = [], [], [], [], [], 0

    def add(self, kept: list[pa.Array], found: Aligned, texts: list[bytes]) -> None:
        i, j, _ = found.links()
        n = [np.bincount(x, minlength=found.n) for x in (found.text_a, found.text_b, found.text_group, found.text_a[i])]
        self.kept.append(kept)
        self.counts.append(np.stack([*n, found.n_shared()]))
        self.digests.extend(hashlib.sha256(t).hexdigest() if t else "" for t in texts)
        self.codes.append(found.a[i] * self.n_b + found.b[j])
        self.sizes.append(n[3])
        self.held += len(i)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The documents, their links as places in the block's list of pairs, and the pairs with their counts."""
        codes, place, times = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        frequent = np.argsort(-times, kind="stable")
        rank = np.empty(len(codes), np.int32)
        rank[frequent] = np.arange(len(codes), dtype=np.int32)
        counts, sizes = np.concatenate(self.counts, axis=1), np.concatenate(self.sizes)
        n, data = len(sizes), rank[place.ravel()].astype("<i4").tobytes()
        ends = _starts(4 * sizes)
        wide = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
        kept = [pa.concat_arrays([k[c] for k in self.kept]) for c in range(len(self.keep))]
        yield self._batch(block, n, [*kept, *map(pa.array, counts), pa.array(self.digests), wide], None)
        yield self._batch(block, len(codes), None, [np.arange(len(codes), dtype=np.int32), codes[frequent], times[frequent]])

    def _batch(self, block: int, n: int, documents: list | None, pairs: list | None) -> pa.RecordBatch:
        names = [*self.keep, *_COUNTS, "groups_sha256", "links"]
        kinds = [*[k.type for k in self.kept[0]], *[pa.int64()] * len(_COUNTS), pa.string(), pa.binary()]
        left = documents or [pa.nulls(n, k) for k in kinds]
        right = [pa.array(p, k) for p, k in zip(pairs, (pa.int32(), pa.int64(), pa.int64()))] if pairs else [pa.nulls(n, k) for k in (pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*left, *right, pa.array(np.full(n, block))], [*names, "place", "code", "times", "block"])


def _summed(keep: Sequence[str]):
    """Documents of one block with the counts of their links' pairs."""

    def run(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        n = np.zeros(pairs.num_rows, np.int64)
        best = np.zeros(pairs.num_rows, np.int64)
        place = pairs["place"].to_numpy()
        n[place], best[place] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
        links = documents["links"].combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(links.buffers()[1], np.int64)[links.offset : links.offset + len(links) + 1] // 4
        own = np.frombuffer(links.buffers()[2] or b"", "<i4")
        sums = [np.concatenate(([0], np.cumsum(v[own])))[ends] for v in (best, n)]
        result = documents.select([*keep, *_COUNTS, "groups_sha256"])
        return result.append_column("n_best", pa.array(np.diff(sums[0]))).append_column("count_sum", pa.array(np.diff(sums[1])))

    return run


def align(docs: DataFrame, path_a: str, path_b: str, keep: Sequence[str] = ("doc_id",), block_links: int = BLOCK_LINKS) -> DataFrame:
    """``keep`` columns, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best and count_sum of every row of ``docs``.

    A is the tokenizers file ``path_a``, B the sentencepiece model ``path_b``, both of the driver; strings of special
    tokens are plain text. n_links counts overlaps, n_shared pairs of one group; groups_sha256 is the digest of the
    groups' ids; n_best counts links whose id pair is as frequent in the corpus as any pair of its B id, and count_sum
    adds up their pairs' frequencies. Texts that are null or empty, or whose bytes a side does not give back, have
    zeros and an empty digest. Repeated rows count each; ties for the most frequent pair are all best. Texts may have
    any length; an empty table gives an empty result. Other columns are not read; ``keep`` may not hold a result's name.
    """
    _clear(keep, (*_COUNTS, "groups_sha256", "links", "place", "code", "times", "block", "n_best", "count_sum"))
    files = _shared_files(docs, path_a, path_b)
    n_b = _tokenizers(*files.value).n_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*files.value)
        number = TaskContext.get().partitionId() << 32
        block = _Block(keep, both.n_b)
        for batch in batches:
            column = batch.column(len(keep))
            for part in slices(column, lower=False):
                found = align_texts(both, column.slice(part.first, part.n).to_pylist())
                kept = [c.slice(part.first, part.n) for c in batch.columns[: len(keep)]]
                block.add(kept, found, found.spelled(both.decimals, both.most))
                if block.held >= block_links:
                    yield from block.rows(number)
                    block, number = _Block(keep, both.n_b), number + 1
        if block.kept:
            yield from block.rows(number)

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    rows = materialise(map_batches(docs.select(*keep, "text"), run, f"{own}, {counts}, groups_sha256 string, links binary, place int, code long, times long, block long"))
    pairs = rows.filter("place is not null").select("block", "place", "code", "times")
    frequency = materialise(pairs.groupBy("code").agg(F.sum("times").alias("n")).withColumn("b_id", F.col("code") % n_b))
    # as many rows as B has ids
    most = F.broadcast(frequency.groupBy("b_id").agg(F.max("n").alias("most")))
    known = frequency.join(most, "b_id").select("code", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    fetched = pairs.join(known, "code").select(F.col("block").alias("of_block"), "place", "n", "best")
    documents = rows.filter("place is null").drop("place", "code", "times")
    return documents.groupBy("block").cogroup(fetched.groupBy("of_block")).applyInArrow(_summed(keep), f"{own}, {counts}, groups_sha256 string, n_best long, count_sum long")
