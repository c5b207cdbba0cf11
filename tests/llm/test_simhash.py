"""SimHash near-dedup against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kdframe.llm import simhash
from kdframe.llm.components import connected_components


def brute_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=3):
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    comp = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


def test_edges(docs_of, words):
    long = words(30_000, 1)
    rows = [(5, None), (3, ""), (9, " \n\t "), (4, "One"), (1, "one"), (7, "two words"), (2, long), (8, long.upper().replace("W", "w")),
            (6, long), (6, long), (None, long), (None, "alone here now")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect()]
    assert len(got) == len(rows)
    by_id = {}
    for i, f, c in got:
        by_id.setdefault(i, set()).add((f, c))
    assert by_id[5] == by_id[3] == by_id[9] == {("0" * 16, 3)}
    assert by_id[4] == by_id[1] and {c for _, c in by_id[1]} == {1}
    assert by_id[6] == by_id[2] == by_id[8] and {c for _, c in by_id[2]} == {2}
    assert {c for _, c in by_id[None]} == {2, None}
    for (i, text) in rows:
        if i is not None:
            assert {f for f, _ in by_id[i]} == {f"{brute_fingerprint(text):016x}"}


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    assert simhash.one_of_each(docs_of([])).collect() == []


def test_dense_cell_in_blocks(spark, monkeypatch):
    """Thousands of fingerprints in one cell are compared in blocks and stay fully linked."""
    r = random.Random(4)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(1500):  # a chain that walks away bit by bit within the same cells
        prints.add(base ^ (1 << r.randrange(32, 64)) ^ (1 << r.randrange(32, 64)) ^ (1 << r.randrange(0, 64)))
    prints |= {r.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    as_long = np.array(prints, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "BLOCK", 64)
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in as_long], "fp long"))
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") for a, b in links.collect())
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = brute_components(dict(enumerate(prints)))
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(as_long[i])
    want_roots = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want_roots


def test_one_of_each(docs_of, words):
    a, b = words(60, 1), words(60, 2)
    rows = [(3, a), (1, a), (1, a), (2, b), (None, b), (None, "x y z"), (4, "")]
    kept = simhash.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(1, a), (2, b), (-1, "x y z"), (4, "")])


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 300)] + [(0, i) for i in range(1000, 1500)] + [(r.randrange(5000, 6000), r.randrange(5000, 6000)) for _ in range(400)]
    edges += [(7, 7), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_across_halves(spark):
    """Every split of one to three differing bits over the halves is linked; four bits are not."""
    r = random.Random(2)
    for bits in (1, 2, 3, 4):
        pairs = []
        for _ in range(60):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), bits):
                y ^= 1 << b
            pairs.append((x, y))
        flat = np.array([v for p in pairs for v in p], np.uint64).view(np.int64).tolist()
        links = {frozenset(e) for e in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in flat], "fp long")).collect()}
        want = {frozenset((flat[2 * i], flat[2 * i + 1])) for i in range(60)}
        assert links == (want if bits <= 3 else set())


def test_rejects_wide_distance(spark):
    import pytest
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.range(1).select(F.col("id").alias("fp")), 4)
