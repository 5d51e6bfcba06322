import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from puspark.llm import alignment
from puspark.llm.bpe import byte_symbols
from tests.llm.helpers import docs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    "The quick brown fox; jumps over the lazy dog.",
    "The quick brown fox; jumps over the lazy dog.",
    "naïve Übergröße — 日本語のテキスト 🙂🙃 ​zero",
    "<|endoftext|> and <s> are plain </s> <unk> here",
    "  two  spaces\n\nlines\t\ttabs\r\n",
    "▁ is changed to a space by one side",
    "\x00\x01 control",
    "",
    None,
    " ",
    "x",
    "abc" * 3000,
]


def token_bytes():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of = {c: i for i, c in enumerate(byte_symbols())}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in b.encode(t)]


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(rows):
    """Every pair of tokens of a text compared by its byte ranges."""
    encode_a, encode_b = token_bytes()
    seen, out = [], []
    for doc_id, text in rows:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        if any(b"".join(raw for _, raw in side) != (" " + (text or "")).encode() for side in (a, b)):
            a, b = [], []
        a, b = spans(a), spans(b)
        found = [(x, y) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(([str(i) for i, s, e in a if low <= s and e <= cut], [str(i) for i, s, e in b if low <= s and e <= cut]))
            low = cut
        seen.append((doc_id, a, b, groups, found))
    n = Counter((x[0], y[0]) for *_, found in seen for x, y in found)
    most = Counter()
    for (_, y), times in n.items():
        most[y] = max(most[y], times)
    for doc_id, a, b, groups, found in seen:
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        times = [(n[x[0], y[0]], most[y[0]]) for x, y in found]
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((doc_id, len(a), len(b), len(groups), len(found), sum(len(x) * len(y) for x, y in groups), sum(p == q for p, q in times), sum(p for p, _ in times), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_links", [1, 50, 1 << 22])
def test_equal_to_all_pairs(spark, block_links):
    rng = random.Random(5)
    letters = "aetn .,1\n-éß漢"
    rows = list(enumerate([t[:600] if t else t for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(40)]))
    rows += [(3, TEXTS[3]), (None, TEXTS[0])]
    table = docs(spark, rows, extra=("n_links", "block", "links"))
    got = alignment.align(table, A, B, block_links=block_links).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_links_and_group_links(spark):
    rows = [(1, "Übergröße of naïve tokenizers"), (2, None), (3, "x y")]
    table = docs(spark, rows)
    encode_a, encode_b = token_bytes()
    want, shared = set(), set()
    for i, text in rows:
        a, b = (spans(encode_a(text)), spans(encode_b(text))) if text else ([], [])
        cuts = sorted({0} | ({e for *_, e in a} & {e for *_, e in b}))
        group = lambda s: sum(c <= s for c in cuts)
        for p, x in enumerate(a):
            for q, y in enumerate(b):
                size = min(x[2], y[2]) - max(x[1], y[1])
                if size > 0:
                    want.add((i, p, q, x[0], y[0], size))
                if group(x[1]) == group(y[1]):
                    shared.add((i, p, q, x[0], y[0], None))
    assert set(map(tuple, alignment.links(table, A, B).collect())) == want
    assert set(map(tuple, alignment.links(table, A, B, grouped=True).collect())) == shared
    with pytest.raises(ValueError):
        alignment.links(table, A, B, keep=("doc_id", "a_at"))


def test_products_equal_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, y = rng.random((7, 5)) < 0.4, rng.random((5, 6)) < 0.4
        a, b = (alignment.Rows(np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1]) for m in (x, y))
        dense = np.zeros((7, 6), int)
        row, column, value = alignment.product(a, b)
        dense[row, column] = value
        assert (dense == x.astype(int) @ y.astype(int)).all()
        t = b.transposed(6)
        back = np.zeros((6, 5), bool)
        back[np.repeat(np.arange(6), t.sizes), t.columns] = True
        assert (back == y.T).all()


def test_empty_table(spark):
    table = docs(spark, [(1, "x")]).filter(F.lit(False))
    assert alignment.align(table, A, B).count() == 0
    assert alignment.links(table, A, B).count() == 0


def test_both_libraries_read_texts_alike():
    """Every settled character in several surroundings, and words of any shape."""
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        both = alignment.Tokenizers(a.read(), b.read())
    assert both.fast is not None
    rng, chars = random.Random(4), [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c}1 {c} {c}'s\n{c}  x" for c in rng.sample(chars, 6000) + chars[:3000]]
    texts += ["".join(rng.choice("aeinst'  \n\t.1é") for _ in range(rng.randrange(200))) for _ in range(3000)]
    texts += ["x" * 5000, "\t\n" * 400, "y" * 299 + " " * 299]
    assert [x.tolist() for x in both.encode_a(texts)] == [e.ids for e in both.a.encode_batch(texts, add_special_tokens=False)]
