"""Conversation trie against a plain rebuild of the definition, over one shard and over many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kdframe.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path string"


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", mark(role or "", text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(full.items()):
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    saved, leaves = {}, {}
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        saved[n] = (len(members[n]) - 1) * words + sum(saved[k] for k in kids[n])
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.collect())


@pytest.fixture(params=["one shard", "many shards"])
def shards(spark, request):
    on = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(on, request.param == "one shard")
    yield
    spark.conf.unset(on)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def check(spark, rows):
    df = table(spark, rows)
    assert got(T.prefix_trie(T.with_heads(T.sequences(df)))) == brute(rows)
    assert got(T.prefix_trie(T.sequences(df))) == brute(rows, heads=False)


def test_given_table(spark, shards):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    check(spark, [tuple(r) for r in df.collect()])


def test_shared_prefixes_and_copies(spark, shards):
    r = random.Random(3)
    rows = []
    for c in range(400):
        kind = r.random()
        turns = ["hot first", "hot second"] if kind < 0.4 else [r.choice("ab") + " w" * r.randrange(3) for _ in range(r.randrange(1, 7))]
        if 0.4 < kind < 0.6:
            turns = ["hot first", *turns]
        rows += [(c * 7 % 401, i, r.choice(["user"] * 9 + ["system"]), t) for i, t in enumerate(turns)]
    check(spark, rows)


def test_edges(spark, shards):
    long = [(40, i, "user", f"t{i} " * (i % 5)) for i in range(300)]
    rows = [(0, 0, "u", "a b"), (0, 0, "u", "a b"), (0, None, None, None), (1, 0, "u", ""), (1, 1, "", "u"), (2, 5, "u", "x" * 100_000),
            (None, 0, "u", "lost"), (3, 0, "u", "日本 é\x85z"), (3, 0, "s", "日本"), (9, 0, "u", "short"), (-5, 1, "u", "neg"), (25, 0, "u", "no head"), *long]
    rows += [(41 + i, t, role, text) for i in range(3) for _, t, role, text in long[: 299 + i % 2]]
    df = table(spark, rows)
    assert got(T.prefix_trie(T.sequences(df))) == brute(rows, heads=False)
    assert got(T.prefix_trie(T.with_heads(T.sequences(table(spark, [x for x in rows if x[0] != -5]))))) == brute([x for x in rows if x[0] != -5])
    assert T.prefix_trie(T.with_heads(T.sequences(table(spark, [])))).collect() == []


def test_blocks_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    check(spark, [(c, 0, "u", "the same") for c in range(500)])


def test_turnless_conversations(spark):
    """A short conversation whose head takes all its turns, under a lead that is absent, ends at the root."""
    c = next(c for c in range(21, 39) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 0, "u", "gone")]
    assert got(T.prefix_trie(T.with_heads(T.sequences(table(spark, rows))))) == brute(rows)
    assert brute(rows)[0][1:5] == (0, -1, 1, 0)


def test_perfect_hash_is_minimal_and_collisions_raise():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    assert sorted(T.PerfectHash(a, b).slots(a, b)) == list(range(5000))
    same = np.zeros(2, np.uint64)
    with pytest.raises(RuntimeError, match="share a digest"):
        T.Nodes(same, same, np.array([1, 1]), np.array([[1], [2]]), np.array([-1, -1]))
