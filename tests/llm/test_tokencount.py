"""Token counts against the tokenizers library and a plain search over all segmentations."""

import random

import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from kdframe.llm import tokencount as T


@pytest.fixture(scope="module")
def library():
    m = sentencepiece.SentencePieceProcessor(model_file=T.default_model())
    t = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], unk_id=0, byte_fallback=True))
    return lambda text: len(t.encode(T.MARK + text.replace(" ", T.MARK)).tokens) if text else 0


EDGES = ["", "a", " ", "   ", "\n", "a  b\n\n c ", "日本語 𓀀𓀀x\t\ty", "ééé▁x ▁▁", "x" * 5000, "ab" * 300 + " " * 50 + "q", "\r\n();\r\n", "🙂🙂 ok"]


def test_given_texts_and_edges(spark, docs_of, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + EDGES
    rows = list(enumerate(texts)) + [(5000, None), (None, "null id"), (3, texts[3])]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens) for r in T.token_counts(docs_of(rows)).collect())
    assert got == sorted((i if i is not None else -1, library(t)) for i, t in rows)
    assert T.token_counts(docs_of([])).collect() == []


def brute(text, vocabulary, unknown):
    """Best (score, earliest starts of the last pieces) over every segmentation."""
    best = {0: (0.0, 0)}
    for end in range(1, len(text) + 1):
        options = [(best[a][0] + vocabulary[text[a:end]], -a, best[a][1] + 1) for a in range(end) if text[a:end] in vocabulary]
        if text[end - 1] not in vocabulary:
            a = end - 1
            options.append((best[a][0] + unknown, -a, best[a][1] + len(text[a].encode())))
        s, _, n = max(options)
        best[end] = (s, n)
    return best[len(text)][1]


@pytest.mark.parametrize("inside", [False, True])
def test_ties(inside):
    r = random.Random(1)
    vocabulary = {"".join(r.choice("ab▁" if inside else "ab") for _ in range(r.randint(1, 4))): float(-r.randint(1, 3)) for _ in range(18)}
    vocabulary |= {T.MARK: -2.0, T.MARK + "a": -2.0}
    vocabulary.pop("b", None)
    c = T.Counter(list(vocabulary.items()))
    assert (c.words is None) == any(T.MARK in p.lstrip(T.MARK) for p in vocabulary)
    for _ in range(300):
        text = "".join(r.choice("aab cé\n") for _ in range(r.randint(1, 14)))
        assert c.count(text) == brute(T.MARK + text.replace(" ", T.MARK), vocabulary, min(vocabulary.values()) - 10)


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "KEPT_WORDS", 3)
    monkeypatch.setattr(T, "LONG_TEXT", 10)
    c = T.Counter([(x, -1.0) for x in "abcdefgh▁"])
    assert c.count("a bb ccc dddd eeeee ffffff a") == len("▁a▁bb▁ccc▁dddd▁eeeee▁ffffff▁a") and len(c) <= 3
