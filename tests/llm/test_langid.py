"""Language identification: held-out accuracy, Viterbi against brute force, spans, edge cases."""

import itertools
import zlib

import numpy as np
import pytest

from kdframe.llm import langid as L


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(table):
    truth = {r.doc_id: r.lang for r in table.collect()}
    rows = L.learn_and_identify(table).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def brute(scores, penalty):
    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)),
               key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, x] for i, x in enumerate(best)) - penalty * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_is_optimal():
    r = np.random.default_rng(1)
    for n, langs, penalty in itertools.product((1, 2, 5, 7), (1, 2, 3), (0.1, 1.0, 4.0)):
        for _ in range(8):
            s = r.normal(size=(n, langs)) * 2
            p = L.viterbi(s, penalty)
            value = sum(s[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
            assert value == pytest.approx(brute(s, penalty))


def test_edges_and_spans(spark, docs_of, table):
    model = L.fit(table.filter("lang in ('en', 'de')").unionByName(
        docs_of([(i, "это простой русский текст для проверки", "ru") for i in range(30)]).select(*table.columns)).select("text", "lang"))
    assert model.langs == ["de", "en", "ru"]
    texts = {r.lang: r.text for r in table.filter("lang in ('en', 'de')").orderBy("n_chars").collect()}
    en, de = texts["en"][:600], texts["de"][:600]
    rows = [(1, None), (2, ""), (3, "123 !? 456"), (4, en + " " + de), (5, "проверки"), (None, en), (7, en), (7, en), (8, (en + " ") * 400), (9, "x"), (10, "日本語")]
    got = [(r.doc_id, r.lang_pred, r.score, r.spans) for r in L.identify(docs_of(rows), model).collect()]
    by = {i: (p, s, x) for i, p, s, x in got}
    assert len(got) == len(rows)
    assert all(by[i][:2] == ("und", 0.0) and by[i][2] == [] for i in (1, 2, 3))
    assert by[5][0] == "ru" and by[None][0] == by[7][0] == by[8][0] == "en" and by[9][0] in model.langs and by[10][0] in model.langs
    spans = by[4][2]
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - len(en)) < 40 and 0.3 < by[4][1] < 0.7
    assert L.identify(docs_of([]), model).collect() == []
    nothing = L.learn_and_identify(docs_of([(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_labels_of_held_out_rows_are_not_learned(docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rows = L.learn_and_identify(docs_of([(held, "abc abc", "aa"), (learned, "xyz xyz", "xx"), (None, "abc", "aa")])).collect()
    assert {r.lang_pred for r in rows} == {"xx"}


def test_words_by_code_point():
    at, start, script, bucket = L.Letters().words("Ab1ß 漢字-é")
    assert at.tolist() == [0, 1, 3, 5, 6, 8] and start.tolist() == [0, 2, 3, 5]
    assert [L.SCRIPT_NAMES[s] for s in script] == ["latin", "latin", "han", "latin"] and len(bucket) == 6
