"""Pipeline: each stage against brute force on its own input, planted cases, and the registered queries."""

from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline as cp
from kdframe.llm import quality
from kdframe.llm.common import written

from .test_decontam import brute as brute_leaks
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
LLM = [k for k in entry.queries() if k.startswith("op") and k[2].isdigit()]


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in LLM) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(cp.STAGES) == 5


def stage(name):
    return next(f for n, f in cp.STAGES if name in n)


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = written(stage("quality")(spark, docs, SF), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality.classify(docs, labels).collect() if r.keep}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    one = written(stage("SimHash")(spark, good, SF), "t")
    comp = brute_components({r.doc_id: brute_fingerprint(r.text) for r in good.collect()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(comp.values())) and one.columns == docs.columns

    cut = written(stage("substring")(spark, one, SF), "t")
    before = {r.doc_id: r for r in one.collect()}
    owners = defaultdict(set)
    for r in cut.collect():
        assert r.n_chars == len(r.text)
        w = r.text.lower().split()
        assert not Counter(r.text.split()) - Counter(before[r.doc_id].text.split())
        for j in range(len(w) - 49):
            owners[" ".join(w[j:j + 50])].add(r.doc_id)
    assert cut.columns == docs.columns and not [k for k, v in owners.items() if len(v) > 2]

    clean = written(stage("decontamination")(spark, cut, SF), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in brute_leaks([(r.doc_id, r.text) for r in cut.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - leaks

    mixed = stage("mixing")(spark, clean, SF)
    count = Counter(r.doc_id for r in mixed.collect())
    assert set(count) <= {r.doc_id for r in clean.collect()} and max(count.values()) <= 3


def test_extra_columns_and_edges(spark, docs_of, words):
    rows = [(1, None), (2, ""), (3, words(80, 1)), (3, words(80, 1)), (None, words(80, 2)), (4, words(9000, 3), None, None), (5, words(80, 1))]
    for _, f in cp.STAGES:
        docs = docs_of(rows)
        out = f(spark, docs, SF)
        assert out.columns[:len(docs.columns)] == docs.columns
        out.collect()
        assert f(spark, docs_of([]), SF).collect() == []


def test_run(spark):
    assert cp.run(spark, SF).count() > 50


def test_columns_named_as_the_stages_name_theirs(spark, docs_of, words):
    """Every stage takes documents with columns of the names it uses inside, and leaves them as they are."""
    from pyspark.sql import functions as F
    rows = [(1, words(80, 1)), (2, words(30, 2) + " " + words(80, 1)), (3, words(90, 3)), (4, "")]
    names = ["copy", "spans", "copies", "row", "k", "d", "n", "b", "g", "key", "target", "keep", "block"]
    for _, f in cp.STAGES:
        docs = docs_of(rows).drop(*names)
        docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in names})
        out = written(f(spark, docs, SF), "t")
        assert set(docs.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
        for r in out.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in names if c != "copy")
