"""Byte-pair encoding against the tokenizers library and against merging by plain search."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from kdframe.llm import bpe as B

EDGES = ["", " ", "\n\t ", "a", "Hello Worlds, it's 2024!", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|> <|endoftext", "ΣΑΣ σ ς İI ǅ",
         "é ́x a ́b \x1c\x1d\x85\xa0　z", "don't I'LL we'd'd ''s", "日本語テキスト 한국어 ไทย 🙂🙂👩‍👩‍👧", "ᲉꟋ\U00010d50 ՘࢏ \U000323b0",
         "\0\x01\x7f", "fooBAR" * 400, "ab " * 3000, "1234567 ½ ② ٣", "<|EndOfText|> < |endoftext| >"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(B.default_file())
    t.no_truncation()
    t.no_padding()

    def want(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    return want


def got(df):
    back = B.decode(B.encode(df))
    rows = back.select("doc_id", F.length("ids") / 4, F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256)).collect()
    return sorted((-1 if r[0] is None else r[0], (int(r[1]), r[2], r[3])) for r in rows)


def test_given_texts_and_edges(spark, docs_of, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + EDGES
    rows = list(enumerate(texts)) + [(5000, None), (None, "null id"), (3, texts[3])]
    assert got(docs_of(rows)) == sorted((-1 if i is None else i, library(t)) for i, t in rows)
    assert got(docs_of([])) == []


def test_any_characters(library):
    r = random.Random(5)
    e = B.Encoder(B.read_file())
    pools = [range(32, 127), range(0xA0, 0x250), range(0x300, 0x370), range(0x370, 0x530), range(0x600, 0x700), [32, 10, 0x3000, 0x2003, 0x1C, 39, 0x73, 0x74],
             [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]]
    for _ in range(3000):
        text = "".join(chr(r.choice(r.choice(pools))) for _ in range(r.randrange(1, 30)))
        assert hashlib.sha256(e.encode(text)).hexdigest() == library(text)[1], repr(text)


def test_queue_merges_as_a_plain_search_does():
    r = random.Random(2)
    for _ in range(30):
        tokens, merges = list("abc") + ["a</w>", "b</w>", "c</w>"], []
        for _ in range(12):
            a, b = r.choice([t for t in tokens if "<" not in t]), r.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append([a, b])
        file = json.loads(B.read_file()) | {"added_tokens": []}
        file["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
        e = B.Encoder(json.dumps(file))
        ranks = {tuple(m): i for i, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randrange(1, 25)))
            s = [*word[:-1], word[-1] + "</w>"]
            while True:
                found = [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]
                if not found:
                    break
                i = min(found)[1]
                s[i:i + 2] = [s[i] + s[i + 1]]
            assert [tokens[i] for i in e.piece(word)] == s


def test_long_texts_and_bounds(monkeypatch, library):
    text = "some Words here\x1cand  there, é \n" * 500 + "y" * 9000
    monkeypatch.setattr(B, "PART", 50)
    monkeypatch.setattr(B, "KEPT_WORDS", 3)
    monkeypatch.setattr(B, "KEPT_PIECES", 3)
    e = B.Encoder(B.read_file())
    for t in (text, text + " 日本語"):
        assert hashlib.sha256(e.encode(t)).hexdigest() == library(t)[1] and len(e) <= 3 and len(e.words) <= 3
    e.find = None  # a file whose pattern is not known: all goes through its own pre-tokenizer
    assert hashlib.sha256(e.encode(text)).hexdigest() == library(text)[1]


def test_other_files_are_refused():
    import public_tokenizers
    file = json.loads(B.read_file())
    file["model"]["unk_token"] = "!"
    with pytest.raises(ValueError, match="plain BPE"):
        B.Encoder(json.dumps(file))
    with pytest.raises(ValueError):
        B.Encoder(B.read_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_decode_of_odd_ids(spark):
    rows = [(1, bytearray(np.array([320, 70000, 256], "<u4").tobytes())), (2, None), (3, bytearray())]
    out = {r.doc_id: r.text for r in B.decode(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()}
    v = B.vocabulary_strings(B.read_file())
    assert out == {1: f"{v[320]} {v[256]}", 2: "", 3: ""}
