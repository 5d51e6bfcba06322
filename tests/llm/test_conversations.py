import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from puspark.llm import conversations

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """The trie by recursion over whole lists of turns."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[c].append(((n is not None, n or 0), tie, (role, text)))
    own = {c: [t for *_, t in sorted(r)] for c, r in turns.items()}
    members = defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole = tuple(own.get(base, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, len(whole)))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        inside = [out[p] for p in children[path]]
        ids = sorted(c for c, _ in members[path])
        at_end = sorted(c for c, n in members[path] if n == len(path))
        out[path] = (
            ids[0],
            len(path),
            min(c for c, _ in members[path[:-1]]) if path else None,
            len(ids),
            len(inside),
            sum(o[5] for o in inside) if inside else 1,
            sum(o[6] for o in inside) + (len(ids) - 1) * (len(path[-1][1]) if path else 0),
            hashlib.sha256(",".join(map(str, at_end)).encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted((tuple(r[c] for c in COLUMNS) for r in conversations.prefix_trie(table, **options).collect()), key=str)


def made(seed, n=120, alphabet=2, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c * rng.choice([1, 1, 50]), t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", "é" * rng.randrange(1, 1 + alphabet)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"bands": (1, 2), "shard_nodes": 3, "queue_rows": 2, "hot_rows": 5}])
def test_trie_equals_a_plain_one(spark, options):
    rows = made(1)
    assert found(spark, rows, **options) == plain(rows)


def test_nulls_ties_repeats_and_empty_turns(spark):
    rows = [
        (None, 0, "user", "lost"),
        (0, None, None, None),
        (0, None, "user", "a"),
        (0, 1, "user", "a"),
        (0, 1, "user", "a"),
        (0, 1, "user", ""),
        (100, 2, "user", "no base has this one: its own"),
        (305, 0, "user", "base is missing, may be turnless"),
        (307, 0, "user", "base is missing, may be turnless"),
        (-5, 0, "user", "takes from conversation 0"),
        (-5, 1, "user", "b"),
        *[(200, t, "user", "same") for t in range(40)],
        *[(201, t, "user", "same") for t in range(40)],
        *[(500, None, None, "x") for _ in range(30)],
        *[(c, 0, "user", f"{'y' * 50}") for c in range(600, 640)],
    ]
    assert found(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    table = spark.createDataFrame(made(2, 20), SCHEMA)
    wide = table.withColumns({c: F.lit("z") for c in ("depth", "node", "pos", "part", "chars", "last", "n_convs", "tie")})
    assert sorted((tuple(r[c] for c in COLUMNS) for r in conversations.prefix_trie(wide).collect()), key=str) == plain(made(2, 20))


def test_queue_spills_and_keeps_order():
    rng = random.Random(3)
    queue, want, got = conversations.SpillingQueue(5), [], []
    for _ in range(200):
        item = (rng.randrange(20), (rng.randrange(3), 0), rng.randrange(9))
        queue.push(item)
        want.append(item)
    assert queue.runs
    while queue.peek() is not None:
        head = queue.peek()
        got.append(queue.pop())
        assert got[-1] == head
    assert got == sorted(want)


def test_many_ends_of_one_node_are_spelled_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_IDS", 4)
    rows = [(c, 0, "user", "same") for c in range(150)]
    assert found(spark, rows) == plain(rows)
