"""Decontamination against brute-force containment of all pairs."""

import random
import re

from kdframe.llm import decontam as D


def brute(docs, items, t=0.8):
    out = set()
    for i, item in items:
        w = re.findall(r"\w+", (item or "").lower())
        n = min(5, len(w))
        if not n:
            continue
        want = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)}
        for d, text in docs:
            x = re.findall(r"\w+", (text or "").lower())
            have = {tuple(x[j:j + n]) for j in range(len(x) - n + 1)}
            if len(want & have) >= t * len(want) - 1e-9:
                out.add((d, i, len(want & have), len(want)))
    return out


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in D.contaminated(docs, items).collect()}
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_near_the_threshold_and_edges(spark, docs_of, words, monkeypatch):
    r = random.Random(5)
    items = [(i, words(r.randint(3, 120), 500 + i, 50)) for i in range(30)] + [(90, None), (91, ""), (92, "Three Word Item"), (None, "null id item text here"), (3, words(40, 503, 50))]
    rows = []
    for i, text in items[:30]:
        w = text.split()
        for k in range(4):
            x = list(w)
            for _ in range(k):
                x[r.randrange(len(x))] = "zz"
            rows.append((len(rows), words(r.choice([0, 5, 3000]), i, 50) + " " + ", ".join(x).upper() + " " + words(30, k, 50)))
    rows += [(1000, None), (1001, ""), (1002, "... three-word; ITEM!"), (None, "a null id item text here b"), (5, rows[5][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in D.contaminated(docs_of(rows), table).collect()}
    assert got == want and len(want) > 40
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)  # many blocks
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in D.contaminated(docs_of(rows), table).collect()} == want
    kept = D.clean(docs_of(rows), table)
    assert kept.columns == docs_of(rows).columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(t) for d, t in rows if d not in {w[0] for w in want})


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contaminated(docs_of([]), items).collect() == []
    assert D.contaminated(docs_of([(1, "a b c")]), items.limit(0)).collect() == []
    assert D.clean(docs_of([(1, "a b c")]), items.limit(0)).count() == 1


def test_signature_is_enough():
    for n in range(1, 300):
        assert D.signature_size(n, 0.8) >= min(n, n - -(-8 * n // 10) + 1)
