"""Spelling variants against plain edit distance, over one shard and over many, and edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from kdframe.llm import spelling as S


def one_off(a, b):
    """Exactly one letter put in, left out or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_words(rows, damage):
    n = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(n):
    out = {}
    for w in n:
        near = [u for u in n if one_off(w, u)]
        best = min(near, key=lambda u: (-n[u], u), default=None)
        out[w] = [best if near and n[best] >= 2 * n[w] else None, len(near)]
    rows = []
    for w, (form, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n[w], near, n[form] if form else None))
    return sorted(rows, key=str)


def got(spark, n):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in S.variants(df).collect()), key=str)


@pytest.fixture(params=["one shard", "many shards", "split halves"])
def sizes(request, monkeypatch):
    if request.param != "one shard":
        monkeypatch.setattr(S, "SHARD_LETTERS", 400)
        monkeypatch.setattr(S, "AT_ONCE", 7)
    if request.param == "split halves":
        monkeypatch.setattr(S, "GROUP", 3)


def test_dense_neighbourhoods(spark, sizes):
    r = random.Random(1)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(5, 9))) for _ in range(150)}
    words |= {"".join(r.choice("abÿé") for _ in range(r.randrange(5, 8))) for _ in range(60)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "x" * 700, "x" * 701, "y" + "x" * 700, "x" * 350 + "y" + "x" * 349}
    n = {w: int(3 * 1.9 ** r.randrange(8)) for w in sorted(words)}
    assert got(spark, n) == brute(n)


def test_long_chains_and_ties(spark):
    n = {("abcde" * 6)[:5 + i]: 3 * 2 ** i for i in range(20)} | {"bcdea": 4, "bcdeb": 8, "bcdec": 8, "bcdeé": 8}
    rows = got(spark, n)
    assert rows == brute(n)
    assert {r[2] for r in rows if r[0].startswith("abcde")} == {("abcde" * 6)[:24]}


def test_one_word_and_none(spark):
    assert got(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
    assert S.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_word_counts(spark, docs_of, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += [None, "", "Ünder ÜNDER ünder Ünder", "İstanbul straße STRASSE ābcdef", "x" * 50_000 + " words " * 3, "cafés3cafés cafés"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "words words ×÷words"), (3, texts[3]), (3, texts[3])]
    for held in (S.HELD, 10):
        monkeypatch.setattr(S, "HELD", held)
        have = {r.word: r.n for r in S.word_counts(docs_of(rows), 7).collect()}
        assert have == brute_words(rows, 7)
    assert S.word_counts(docs_of([]), 7).collect() == []


def test_intervals_stay_in_step():
    """Growing to the left and to the right gives the same words as counting in the text."""
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(2, 6))) for _ in range(60)})
    index = S.Index(words)
    for _ in range(200):
        a, b = r.choice(words), r.randrange(2, 5)
        q, w = index.near([a], [min(b, len(a)) - 1])
        want = [i for i, u in enumerate(words) if one_off(a, u) and u.startswith(a[: min(b, len(a)) - 1])]
        assert sorted(w.tolist()) == want
