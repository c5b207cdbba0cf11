"""Kneser-Ney model against a plain implementation; classification on labelled rows and edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from kdframe.llm import quality as Q


LABELS = "doc_id long, quality int, toxic int, text string"


def units(text):
    return np.frombuffer("".join("0" if c in "0123456789" else c for c in text).encode("utf-16-le", "surrogatepass"), "<u2").tolist()


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries: probability of a unit after a context."""
    grams = Counter()
    for t in texts:
        s = [Q.START] * (order - 1) + units(t)
        for i in range(len(units(t))):
            grams[tuple(s[i:i + order])] += 1
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    spare = {}
    for n, c in levels.items():
        k = Counter(c.values())
        if k[1] and k[2]:
            y = k[1] / (k[1] + 2 * k[2])
            d = [min(max(i - (i + 1) * y * k[i + 1] / k[i] if k[i] else 0.5 * i, 0), i) for i in (1, 2, 3)]
        else:
            d = [0.5] * 3
        spare[n] = d
    by = {n: defaultdict(dict) for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            by[n][g[:-1]][g[-1]] = v

    def p(context, symbol):
        n = len(context) + 1
        below = p(context[1:], symbol) if context else 1 / (len(levels[1]) + 1)
        seen = by[n].get(context)
        if not seen:
            return below
        total, d = sum(seen.values()), spare[n]
        cut = lambda v: d[min(v, 3) - 1] if v else 0
        return (seen.get(symbol, 0) - cut(seen.get(symbol, 0)) + sum(map(cut, seen.values())) * below) / total
    return p


@pytest.mark.parametrize("block,held", [(8192, 1 << 21), (7, 300)])
def test_scores_against_a_plain_model(spark, docs_of, monkeypatch, block, held):
    """Units and log-probabilities of every document, in one block and in many."""
    monkeypatch.setattr(Q, "BLOCK", block)
    monkeypatch.setattr(Q, "HELD", held)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text[:400] for r in table.limit(25).collect()]
    other = [texts[0][:120], "ÉTÉ: 12% !!", "zq\n\tß漢字 🙂𝔘", "Пришла весна", "ЫЫЫ", "", None]
    labels = spark.createDataFrame([(i, 1, 0, "") for i in range(25)] + [(999, 1, 0, "")], LABELS)
    rows = Q.scored(docs_of(list(enumerate(texts + other))), labels, ["doc_id", "lang"]).collect()
    p = plain_model(texts, Q.ORDER)
    assert len(rows) == 32 and {r.doc_id for r in rows if r.llm_trusted} == set(range(25))
    for r in rows:
        s = units((texts + other)[r.doc_id] or "")
        padded = [Q.START] * (Q.ORDER - 1) + s
        want = -sum(math.log(p(tuple(padded[i:i + Q.ORDER - 1]), padded[i + Q.ORDER - 1])) for i in range(len(s)))
        assert r.llm_symbols == len(s) and r.llm_nll == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_other_scripts_are_told_apart(spark, docs_of):
    """Noise of a script with the word shapes of real text does not score like real text."""
    import random
    r = random.Random(1)
    words = ["река", "ночь", "дорога", "никто", "видел", "совет", "мост", "снова", "камень", "песок", "вода", "город"]
    real = [" ".join(r.choice(words) for _ in range(60)) for _ in range(60)]
    noise = "".join(c if c == " " else r.choice("бвгджзклмнпрстфхцчшщъыьэюя") for c in real[0])
    labels = spark.createDataFrame([(i, 1, 0, "") for i in range(50)], LABELS)
    rows = {x.doc_id: x for x in Q.classify(docs_of([(i, t, "ru") for i, t in enumerate([*real, noise, "Ы" * 300])]), labels).collect()}
    assert not rows[60].keep and not rows[61].keep and all(rows[i].keep for i in range(60))
    assert rows[60].perplexity > 3 * rows[59].perplexity


def test_no_table_of_the_model_is_broadcast_or_collected(spark, docs_of):
    labels = spark.createDataFrame([(0, 1, 0, "")], LABELS)
    plan = Q.scored(docs_of([(0, "a b"), (1, "c")]), labels, ["doc_id", "lang"])._jdf.queryExecution().optimizedPlan().toString()
    hinted = [x for x in plan.splitlines() if "strategy=broadcast" in x]
    assert hinted and all("Join Cross" in x for x in hinted)  # one-row sums and discounts only


def junk(text):
    w = text.split()
    return " | " in text or "### " in text or "!! " in text


def test_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    keep = {r.doc_id: r.keep for r in Q.classify(docs, labels).collect()}
    good = [r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(keep) == len(text)
    assert sum(not keep[i] for i in good) <= 0.01 * len(good)
    noisy = [i for i, t in text.items() if junk(t)]
    assert sum(keep[i] for i in noisy) <= 0.05 * len(noisy)
    clean = Q.kept(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, k in keep.items() if k}


def test_edges(spark, docs_of, words):
    rows = [(i, words(60, i), "en") for i in range(40)] + [(50, None), (51, ""), (52, words(40_000, 9), "en"), (53, words(50, 60), None),
                                                           (54, words(50, 61), "xx"), (None, words(50, 62), "en"), (1, words(60, 1), "en"), (55, "%%% ### $$$ *** " * 30, "en")]
    labels = spark.createDataFrame([(i, 1, 0, "") for i in range(38)] + [(2, 0, 0, ""), (3, None, 0, ""), (4, 1, None, ""), (5, 1, 1, ""), (None, 1, 0, ""), (55, 0, 0, "")], LABELS)
    assert {r.doc_id for r in Q.trusted_ids(labels).collect()} == set(range(38)) - {2, 3, 4, 5}
    got = Q.classify(docs_of(rows), labels).collect()
    keep = {r.doc_id: r.keep for r in got}
    assert len(got) == len(rows) and not keep[50] and not keep[51] and not keep[55]
    assert keep[52] and keep[53] and keep[54] and keep[None] and all(keep[i] for i in range(40))
    assert all((r.perplexity is None) == (r.doc_id in (50, 51)) for r in got)
    none = Q.classify(docs_of(rows), labels.limit(0)).collect()
    assert {r.doc_id for r in none if not r.keep} == {50, 51}
    assert Q.classify(docs_of([]), labels).collect() == [] and Q.kept(docs_of([]), labels).collect() == []
