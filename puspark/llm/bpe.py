"""Byte-pair encoding by backtracking, and decoding by an offset table.

Words become strings of a symbol per byte; the last byte of a word has a symbol of its own where the vocabulary marks
word ends. An Aho-Corasick automaton of the reversed tokens gives the longest token at every place of a word. The
encoder takes the longest token, then shorter ones, that may follow the one before, and goes back where none may; a
place that led nowhere is not tried again. Two tokens may stand side by side if undoing their merges, latest first,
never shows a pair across their border that would have merged earlier: the table of pairs answers that. A row of tokens
whose neighbours all may stand side by side is what merging by rank gives, in a time linear in the word's length.

Executors get the vocabulary file's bytes by broadcast: its size is that of one file, whatever the texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache, cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from puspark.llm.text import map_batches

#: Words, and texts without white space, whose tokens a task keeps since it last set aside those before; these it keeps
#: till then as well, so that frequent ones stay.
KEPT_WORDS = 1 << 17
#: Answers about pairs of tokens that a task keeps.
KEPT_PAIRS = 1 << 18
#: Characters of the property White_Space, and others that str.split takes for it.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, SEPARATORS = re.compile(f"[{WHITE_SPACE}]+"), re.compile("[\x1c-\x1f]")
#: Tokens of a result batch, besides the rest of a longer text.
BATCH_TOKENS = 1 << 18


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Offsets:
    """Byte strings by id in one buffer with offsets; any list of ids is spelled by one gather."""

    def __init__(self, spelled: Sequence[bytes]):
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.sizes = self.ends - self.starts

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        return self.data[np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Merges:
    """Tokens numbered by merge: symbols first, then one token per merge in order of rank."""

    def __init__(self, symbols: Sequence[str], merges: Sequence[tuple[str, str]]):
        spelled = list(dict.fromkeys([*symbols, *(a + b for a, b in merges)]))
        if len(spelled) != len(symbols) + len(merges):
            raise ValueError("two merges make the same token")
        number = {s: i for i, s in enumerate(spelled)}
        self.spelled, self.atoms = spelled, len(symbols)
        self.left = [0] * self.atoms + [number[a] for a, _ in merges]
        self.right = [0] * self.atoms + [number[b] for _, b in merges]
        self.pairs = {(a, b): self.atoms + i for i, (a, b) in enumerate(zip(self.left[self.atoms :], self.right[self.atoms :]))}
        self.size = [len(s) for s in spelled]
        # tokens that merging by rank never makes, as an earlier merge parts them, are no candidates
        made = [i < self.atoms or self._compatible(self.left[i], self.right[i], i) for i in range(len(spelled))]
        for i in range(self.atoms, len(spelled)):
            made[i] = made[i] and made[self.left[i]] and made[self.right[i]]
        self.number = {s: i for s, i in number.items() if made[i]}
        self.shorter = [next((self.number[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.number), -1) for s in spelled]
        self.most = max(map(len, self.number), default=0)
        self.automaton = ahocorasick.Automaton()
        for s, i in self.number.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves ``a`` and ``b`` side by side."""
        key = a << 32 | b
        if (found := self.known.get(key)) is None:
            if len(self.known) >= KEPT_PAIRS:
                self.known.clear()
            found = self.known[key] = self._compatible(a, b, len(self.spelled))
        return found

    def _compatible(self, a: int, b: int, earliest: int) -> bool:
        """Whether no merge before number ``earliest`` crosses the border of ``a`` and ``b``."""
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < earliest:
                return False
            if a < self.atoms and b < self.atoms:
                return True
            if a > b:  # ``a`` came last: its right part met ``b`` until merge number a
                earliest, a = a, self.right[a]
            else:  # a merge of the same number further left goes first
                earliest, b = b + 1, self.left[b]

    def encode(self, text: str) -> list[int]:
        """Token numbers of a text of symbols."""
        if (whole := self.number.get(text)) is not None:
            return [whole]
        taken: list[int] = []
        at, last, size, known = 0, -1, self.size, self.known.get
        for _, token in self.automaton.iter_long(text):
            if last >= 0 and not (self.compatible(last, token) if (fits := known(last << 32 | token)) is None else fits):
                return self._backtracked(text, taken, at, token)
            taken.append(token)
            at, last = at + size[token], token
        if at < len(text):
            raise ValueError(f"no tokens for {text[at:][:40]!r}")
        return taken

    def _backtracked(self, text: str, taken: list[int], at: int, token: int) -> list[int]:
        """The rest of ``encode`` from the first token, at ``at``, that may not follow the longest ones before it."""
        size, shorter, compatible, longest, end = self.size, self.shorter, self.compatible, self.automaton.iter_long, len(text)
        dead: set[int] = set()
        number, known, most = self.number, self.known.get, self.most
        while True:
            last = taken[-1] if taken else -1
            while token >= 0:
                if not (dead and at + size[token] in dead):
                    if last < 0 or (compatible(last, token) if (fits := known(last << 32 | token)) is None else fits):
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += size[token]
                if at == end:
                    return taken
                # the rest of a word is often a token, and none is longer then
                if end - at > most or (token := number.get(text[at:], -1)) < 0:
                    token = next(longest(text, at))[1]
            elif taken:
                dead.add(at)
                at -= size[last]
                token = shorter[taken.pop()]
            else:
                raise ValueError(f"no tokens for {text[:40]!r}")


class Recent:
    """Tokens of short texts that were seen lately: ``fresh`` ones, and those set aside when there were too many."""

    def __init__(self):
        self.fresh: dict[str, tuple[int, ...]] = {}
        self.aside: dict[str, tuple[int, ...]] = {}

    def __len__(self) -> int:
        return len(self.fresh) + len(self.aside)

    def again(self, text: str) -> tuple[int, ...] | None:
        """Tokens of a text that is not fresh; it is now."""
        if (found := self.aside.get(text)) is not None:
            self.keep(text, found)
        return found

    def keep(self, text: str, ids: tuple[int, ...]) -> None:
        if len(text) <= 64:
            if len(self.fresh) >= KEPT_WORDS:
                self.fresh, self.aside = {}, self.fresh
            self.fresh[text] = ids


class Vocabulary:
    """A tokenizer file: NFC, white space to one space, lower case; words by a pattern; byte-level pairs with word ends.

    Strings of added tokens in a text are those tokens. Other kinds of files are refused.
    """

    def __init__(self, content: str):
        self.content, file = content, json.loads(content)
        model, marked = file["model"], file["model"].get("end_of_word_suffix") or ""
        normal = [n["type"] for n in file["normalizer"]["normalizers"]]
        split, bytes_ = file["pre_tokenizer"]["pretokenizers"]
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or file.get("decoder"))
        usual = split["behavior"] == "Removed" and split["invert"] and bytes_["type"] == "ByteLevel" and not bytes_["add_prefix_space"] and not bytes_["use_regex"]
        added, replace = file["added_tokens"], file["normalizer"]["normalizers"][1]
        bare = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if not (normal == ["NFC", "Replace", "Lowercase"] and plain and usual and bare and marked):
            raise ValueError("a file of another kind than byte-level pairs with word ends")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        if replace["pattern"]["Regex"] != r"\s+" or replace["content"] != " " or any(map(self.pattern.search, WHITE_SPACE)):
            raise ValueError("words of this file may hold white space")
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.inner, of = [chr(b) for b in range(256)], byte_symbols()
        self.final = [chr(256 + b) for b in range(256)]
        own = {**{of[b]: self.inner[b] for b in range(256)}, **{of[b] + marked: self.final[b] for b in range(256)}}

        def symbols(token: str) -> str:
            ended = token.endswith(marked)
            body = token[: -len(marked)] if ended else token
            return "".join(own[c] for c in body[:-1]) + own[body[-1] + (marked if ended else "")]

        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Merges([*self.inner, *self.final], [(symbols(a), symbols(b)) for a, b in merges])
        names = {symbols(name): i for name, i in model["vocab"].items()}
        self.ids = [names[s] for s in self.merges.spelled]
        spelled = [b""] * (1 + max([*self.ids, *self.added.values()]))
        for name, i in [*model["vocab"].items(), *self.added.items()]:
            spelled[i] = name.encode() + b" "
        self.offsets = Offsets(spelled)
        self.known, self.chunks = Recent(), Recent()
        self.settled: set[str] = set()

    @cached_property
    def library(self):
        """The library, asked for the words of texts with characters on which versions of Unicode differ."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.content)

    def words(self, text: str) -> list[str]:
        if not text.isascii() and not self._settled(text):
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        # lower case is taken per character there: no final sigma; white space is in no word, so none is replaced
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _settled(self, text: str) -> bool:
        """Whether all characters of a text are alike in all versions of Unicode; those found to be are kept."""
        fresh = set(text) - self.settled
        if any(map(differs, fresh)):
            return False
        self.settled |= fresh
        return True

    def word_ids(self, word: str) -> tuple[int, ...]:
        raw, ids = word.encode(), self.ids
        return tuple([ids[t] for t in self.merges.encode(raw[:-1].decode("latin-1") + self.final[raw[-1]])])

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without white space, and a note of them: words end at white space at the latest."""
        if (found := self.chunks.again(chunk)) is not None:
            return found
        out: list[tuple[int, ...]] = []
        for word in self.words(chunk):
            if (found := self.known.fresh.get(word)) is None and (found := self.known.again(word)) is None:
                found = self.word_ids(word)
                self.known.keep(word, found)
            out.append(found)
        found = out[0] if len(out) == 1 else tuple(chain.from_iterable(out))
        self.chunks.keep(chunk, found)
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.marks.split(text) if self.marks else [text]
        get = self.chunks.fresh.get
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.added[part])
                continue
            # separators that only Python takes for white space stay inside
            for chunk in SPACE.split(part) if SEPARATORS.search(part) else part.split():
                if (found := get(chunk)) is None:
                    found = self.chunk_ids(chunk)
                    get = self.chunks.fresh.get
                out += found
        return out


def differs(c: str) -> bool:
    """Whether versions of Unicode may differ on a character: without a category in Python's tables, as those of other
    libraries may be newer, or younger than Unicode 3.2 and moved or taken apart by normal forms, as they may be older."""
    if unicodedata.category(c) == "Cn":
        return True
    return unicodedata.ucd_3_2_0.category(c) == "Cn" and bool(unicodedata.combining(c) or unicodedata.decomposition(c))


@cache
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def _mapped(df: DataFrame, path: str, column: str, name: str, kind: str, keep: Sequence[str], convert) -> DataFrame:
    """``keep`` and what ``convert(vocabulary, values)`` makes of slices of the column, one after another."""
    if name in (c.lower() for c in keep):
        raise ValueError(f"a kept column has the name of the result, {name}")
    with open(path, encoding="utf-8") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            first = 0
            for made in convert(vocabulary, batch.column(len(keep))):
                kept = [c.slice(first, len(made)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, made], [*keep, name])
                first += len(made)

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], f"`{name}` {kind}"])
    return map_batches(df.select(*keep, column), run, schema)


def _encoded(vocabulary: Vocabulary, texts: pa.Array) -> Iterator[pa.Array]:
    """Lists of ids, a bounded number of tokens at a time besides the rest of a longer text."""
    flat, ends = [], [0]
    for text in texts:
        flat.extend(vocabulary.encode(text.as_py() or ""))
        ends.append(len(flat))
        if len(flat) >= BATCH_TOKENS:
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            flat, ends = [], [0]
    if len(ends) > 1:
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))


def _decoded(vocabulary: Vocabulary, lists: pa.Array) -> Iterator[pa.Array]:
    """Texts of lists of ids, by one gather for a bounded number of tokens besides the rest of a longer list."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
    flat, row = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), 0
    while row < len(lists):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + BATCH_TOKENS, "right")) - 1)
        ids = flat[ends[row] : ends[last]]
        data, at = vocabulary.offsets.spell(ids), np.concatenate(([0], np.cumsum(vocabulary.offsets.sizes[ids])))[ends[row : last + 1] - ends[row]]
        raw = data.tobytes()
        # the space after a text's last token is left out
        yield pa.array([raw[s : e - 1] if e > s else b"" for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()).cast(pa.string())
        row = last


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids`` (array<int>) of every row's whole text, by the tokenizer file ``path`` of the driver.

    Ids are those that the tokenizers library gives without special tokens around the text; strings of added tokens
    inside it are those tokens. Null and empty texts, and texts of white space, have no ids. Texts may have any length:
    one text is one row, its memory grows with its own length. Rows are read one by one, so that repeated rows are
    alike; an empty table gives an empty result. Other columns are not read; ``keep`` may not hold ``ids``.
    """
    return _mapped(docs, path, text, "ids", "array<int>", keep, _encoded)


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded``: tokens of ``ids`` as the file writes them, joined by one space, added ones too.

    Null and empty lists give an empty text; ids that the file does not have are an error. ``keep`` may not hold
    ``decoded``.
    """

    return _mapped(encoded, path, ids, "decoded", "string", keep, _decoded)
