"""Forms built for scale against their plain counterparts, and the plans they promise."""

import math
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from kdframe.functions import arrays as ar
from kdframe.operators import distill as ds
from kdframe.operators import evaluation as ev
from kdframe.operators import fit as ft
from kdframe.operators import fit_sharded as fs
from kdframe.operators import hidden as hd
from kdframe.operators import ordering as od
from kdframe.operators import patterns as pt
from kdframe.operators import sequences as sq
from kdframe.operators import tokens as tk
from kdframe.plans import score_queries, sequence_queries, token_queries
from kdframe.sources import fixtures as fx

from .conftest import SF001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, name):
    return plan_of(df).count(name)


# ---- tiled projection

@pytest.mark.parametrize("tile,states", [((3, 5), 2), ((100, 100), 4096), ((1, 1), 3), ((4, 7), 1)])
def test_tiled_projection_equals_numpy(spark, tile, states):
    r = np.random.default_rng(1)
    w = {layer: r.normal(size=(6 + layer, 9)) for layer in range(2)}
    rows = [(layer, o, w[layer][o].tolist(), float(o)) for layer in w for o in range(len(w[layer]))]
    h = [(e, p, layer, r.normal(size=9).tolist()) for e in range(4) for p in range(3) for layer in range(3)]
    weights = spark.createDataFrame(rows, "layer int, out_idx int, w array<double>, b double")
    hidden = spark.createDataFrame(h, "example_id long, pos int, layer int, h array<double>")
    got = {(x.example_id, x.pos, x.layer): x.h for x in hd.project_hidden_tiled(hidden, weights, tile=tile, states=states).collect()}
    assert set(got) == {(e, p, layer) for e, p, layer, _ in h if layer < 2}          # a layer without a projection is dropped
    for e, p, layer, x in h:
        if layer < 2:
            assert got[(e, p, layer)] == pytest.approx(w[layer] @ x + np.arange(len(w[layer])))


def test_wide_projection_holds_no_matrix_in_a_row(spark):
    """1536 to 1100: tiles of at most 512 x 1024, and as many groups a layer as its states need."""
    r = np.random.default_rng(2)
    w = r.normal(size=(1100, 1536))
    weights = spark.createDataFrame([(0, o, w[o].tolist(), 0.5) for o in range(1100)], "layer int, out_idx int, w array<double>, b double")
    tiles = hd.weight_tiles(weights)
    assert tiles.agg(F.max(F.size("w"))).first()[0] <= 512 * 1024 and tiles.count() == 3 * 2
    x = r.normal(size=(30, 1536))
    hidden = spark.createDataFrame([(i, 0, x[i].tolist()) for i in range(30)], "example_id int, layer int, h array<double>")
    got = {g.example_id: g.h for g in hd.project_hidden_tiled(hidden, weights, states=8).collect()}
    for i in range(30):
        assert got[i] == pytest.approx(w @ x[i] + 0.5)


def test_tiled_projection_edges(spark):
    weights = spark.createDataFrame([(0, 0, [1.0, 2.0], 0.0)], "layer int, out_idx int, w array<double>, b double")
    empty = spark.createDataFrame([], "example_id int, layer int, h array<double>")
    assert hd.project_hidden_tiled(empty, weights).collect() == []
    wrong = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0])], "example_id int, layer int, h array<double>")
    with pytest.raises(Exception, match="differ in size"):
        hd.project_hidden_tiled(wrong, weights).collect()


def test_hidden_loss_is_the_same_with_tiles(spark):
    s = fx.hidden_states(spark, SF001, "student").withColumn("batch_id", F.col("example_id") % 3)
    t, w = fx.hidden_states(spark, SF001, "teacher"), fx.projections(spark)
    plain = {r.batch_id: r.kd for r in hd.hidden_kd_loss(s, t, w).collect()}
    tiled = {r.batch_id: r.kd for r in hd.hidden_kd_loss(s, t, w, project=lambda h, w: hd.project_hidden_tiled(h, w, tile=(3, 5), states=500)).collect()}
    assert tiled == pytest.approx(plain)


# ---- one pass over the pairs

def test_kd_and_ce_equal_the_two_pass_form(spark):
    pairs = fx.logits_pair(spark, SF001, 60).withColumn("batch_id", F.floor(F.col("example_id") / 2))
    labels = fx.labels_tok(spark, SF001).withColumn("label", F.when(F.col("pos") == 3, -100).otherwise(F.col("label")))
    ce = ds.hard_ce(pairs.withColumnRenamed("s", "logits"), labels)
    two = {r.batch_id: (r.kd, r.ce, r.loss) for r in ds.kd_loss_logits(pairs, ce).collect()}
    one_df = ds.kd_loss_logits(pairs, None, following=ds.next_labels(labels))
    one = {r.batch_id: (r.kd, r.ce, r.loss) for r in one_df.collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k] == pytest.approx(two[k])
    ignored = ds.next_labels(labels.withColumn("label", F.lit(-100)))
    r = ds.kd_loss_plain(pairs, None, following=ignored).first()
    assert r.ce is None and r.loss == pytest.approx(0.5 * r.kd)


def test_losses_read_the_pairs_once(spark):
    """Embeddings are scanned for both sides, the labels and a count: no second reading for the CE."""
    for q in (score_queries.q_kd_loss_logits, score_queries.q_kd_loss_plain):
        assert nodes(q(spark, SF001), "FileScan") <= 4


def test_stored_scores_join_without_an_exchange(spark, tmpdir_path):
    names = [f"t_{uuid.uuid4().hex}" for _ in range(3)]
    keep = lambda df, i: ds.write_bucketed(df, names[i], 4, path=os.path.join(tmpdir_path, names[i]))
    bid = F.floor(F.col("example_id") / 2)
    s = keep(fx.student_logits(spark, SF001, 60), 0)
    t = keep(fx.teacher_logits(spark, SF001), 1)
    following = keep(ds.next_labels(fx.labels_tok(spark, SF001)), 2)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = ds.align_scores(s, t).withColumn("batch_id", bid)
        out = ds.kd_loss_logits(pairs, None, following=following)
        text = plan_of(out)
        below = text[text.index("SortMergeJoin"):]
        assert "Exchange" not in below and below.count("Bucketed: true") == 3
        got = {r.batch_id: r.loss for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    plain = fx.logits_pair(spark, SF001, 60).withColumn("batch_id", bid)
    want = {r.batch_id: r.loss for r in ds.kd_loss_logits(plain, None, following=ds.next_labels(fx.labels_tok(spark, SF001))).collect()}
    assert got == pytest.approx(want)


# ---- pairs of sequences

def test_runs_and_scatter(spark):
    masks = [[], [0], [1], [1, 1, 0, 1], [0, 0, 1, 1, 0, 1, 0], [1] * 5, [0, 1, 0, 1, 0]]
    rows = [(i, m, list(range(10, 10 + sum(m)))) for i, m in enumerate(masks)]
    df = spark.createDataFrame(rows, "i int, m array<int>, v array<int>")
    for r in df.select("i", "m", "v", ar.runs_of_ones("m").alias("r"), ar.scatter("v", "m").alias("s")).collect():
        covered = [c for a, b in r.r for c in range(a, b)]
        assert covered == [c for c, m in enumerate(r.m) if m == 1]
        it = iter(r.v)
        assert r.s == [next(it) if m == 1 else 0 for m in r.m]


def test_flush_left_cuts_at_the_first_gap_of_the_batch(spark):
    """Masks with holes: the cut is the first column no row of the batch uses, not the longest row."""
    rows = [(0, 0, [0, 1, 1, 0, 0, 1], list(range(6))), (0, 1, [1, 0, 0, 0, 0, 0], list(range(6))),
            (1, 0, [1, 0, 1, 0], [5, 6, 7, 8]), (1, 1, [0, 1, 1, 1], [1, 2, 3, 4]), (2, 0, [0, 0], [1, 2])]
    df = spark.createDataFrame(rows, "batch_id int, row long, attention_mask array<int>, input_ids array<int>")
    out = {(r.batch_id, r.row): (r.attention_mask, r.input_ids) for r in sq.flush_left(df, others=("input_ids",)).collect()}
    assert out == {(0, 0): ([1, 1], [1, 2]), (0, 1): ([1, 0], [0, 1]), (1, 0): ([1, 0, 1], [5, 6, 7]), (1, 1): ([1, 1, 1], [2, 3, 4]),
                   (2, 0): ([], [])}


@pytest.mark.parametrize("query", ["stack_pairs", "concat_prompt_completion", "flush_left", "truncate_seq", "logits_to_keep",
                                   "pack_padding_free", "unpack_padding_free", "split_packed", "shift_labels"])
def test_pair_queries_encode_once(spark, query):
    df = getattr(sequence_queries, f"q_{query}")(spark, SF001)
    text = plan_of(df)
    assert text.count("ArrowEvalPython") == 1 and text.count("FileScan") <= 3
    assert "posexplode(attention_mask" not in text


# ---- encoding and packing

def test_encode_with_block_dictionaries(spark):
    r = random.Random(1)
    rows = [(i, None if i % 17 == 0 else " ".join(["the"] + [r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(i % 9)])) for i in range(300)]
    rows += [(1000, ""), (None, "the a")]
    df = spark.createDataFrame(rows, "k long, text string")
    vocab = tk.fit_vocab(df, "text", 12)
    udf = {x.k: x.input_ids for x in tk.encode(df, "text", vocab).collect()}
    join = tk.encode(df, "text", vocab, key="k", method="join", block_rows=16)
    assert {x.k: x.input_ids for x in join.collect()} == udf
    empty = df.limit(0)
    assert tk.encode(empty, "text", vocab, key="k", method="join").collect() == []


def test_packing_encodes_once(spark):
    """Lengths come from the JVM, so ids are made once, in the job that puts the blocks together."""
    df = spark.createDataFrame([(i, "a b c"[: 1 + 2 * (i % 3)]) for i in range(40)], "k long, text string")
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def ids(text):
        made.add(1)
        return [ord(c) for c in text.split()]

    enc = df.withColumn("ids", ids.asNondeterministic()("text"))
    out = {r.block_id: r.input_ids for r in tk.pack_sequences(enc, ["k"], "ids", 7, length=F.size(F.split("text", " "))).collect()}
    flat = [ord(c) for i in range(40) for c in "a b c"[: 1 + 2 * (i % 3)].split()]
    assert out == {i: flat[7 * i: 7 * i + 7] for i in range(-(-len(flat) // 7))}
    assert made.value == 40


def test_packing_by_other_keys(spark):
    rows = [(f"k{i % 5}", i, list(range(i, i + i % 4))) for i in range(50)] + [("null", 99, None), (None, 98, [7, 7])]
    df = spark.createDataFrame(rows, "a string, b int, ids array<int>")
    out = {r.block_id: r.input_ids for r in tk.pack_sequences(df, ["a", "b"], "ids", 6).collect()}
    flat = [x for _, _, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])) for x in ids or []]
    assert [x for i in sorted(out) for x in out[i]] == flat and all(len(out[i]) == 6 for i in sorted(out)[:-1])


def test_position_of_wide_rows_freezes_keys_only(spark):
    df = spark.createDataFrame([(f"k{i:03d}", "payload" * 5, i % 3) for i in range(60)], "k string, wide string, w int")
    got = {r.k: (r.idx, r.wide) for r in od.global_index(df.repartition(7), ["k"]).collect()}
    assert got == {f"k{i:03d}": (i, "payload" * 5) for i in range(60)}


def test_dual_encode_fits_its_vocabulary_once(spark, monkeypatch):
    fits = []
    real = token_queries.tk.fit_vocab
    monkeypatch.setattr(token_queries.tk, "fit_vocab", lambda *a, **k: fits.append(1) or real(*a, **k))
    df = token_queries.q_dual_encode(spark, SF001)
    assert len(fits) == 1 and nodes(df, "regexp_extract_all") <= 4
    assert "documents.parquet" not in plan_of(df)          # the written vocabulary is read, the corpus is not


# ---- patterns

def test_pattern_index_equals_plain_search(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abcd") for _ in range(r.randrange(0, 9))) for _ in range(200)] + [None, "", "ab", "日本語", "a日b"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    for pats in (["abc", "dd", None, "cdab", "a", "日"], ["bcdab", "zzz"], [""], [None], [], ["", "a"], ["日本語", "本語x"]):
        table = spark.createDataFrame([(p,) for p in pats], "pattern string")
        want = {i: n is not None and any(p is not None and p in n for p in pats) for i, n in enumerate(names)}
        assert {x.i: x.flag for x in pt.pattern_flag(df, "name", table).collect()} == want
        assert {x.i for x in pt.pattern_rows(df, "name", table, keep=False).collect()} == {i for i in want if not want[i]}


def test_many_patterns_without_a_nested_loop(spark):
    df = spark.range(300).select(F.concat(F.lit("layer."), F.col("id").cast("string"), F.lit(".weight")).alias("name"))
    pats = spark.range(20000).select(F.concat(F.lit("."), F.col("id").cast("string"), F.lit(".w")).alias("pattern"))
    found = pt.matches(df, "name", pats)
    assert found.count() == 300 and "NestedLoop" not in plan_of(found)


# ---- choice scoring

def test_only_generations_without_a_letter_carry_text(spark):
    gens = spark.createDataFrame([("m", "d", "0", 1, "The answer is (B). " + "x" * 50), ("m", "d", "0", 2, "red thing"), ("m", "d", "0", 1, None)],
                                 "model string, dataset string, shot string, item_id long, generation string")
    items = spark.createDataFrame([(1, "q", (["u", "v"], ["A", "B"]), "B"), (2, "q", (["blue", "red thing"], ["A", "B"]), "A")],
                                  "item_id long, question string, choices struct<text:array<string>,label:array<string>>, answerKey string")
    full = ev.score_arc(gens, items)
    assert sorted((r.item_id, r.pred or "", r.correct, r.generation or "") for r in full.collect()) == [
        (1, "", False, ""), (1, "B", True, "The answer is (B). " + "x" * 50), (2, "B", False, "red thing")]
    text = plan_of(full.select("item_id", "correct"))
    below = text[text.index("Join"):]
    assert "isnull(_letter" in below or "CASE WHEN" in below          # the text is emptied on its way to the join


# ---- fits

def _task(spark, n=60, k=3, d=4, label=None):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(d)], [r.gauss(0, 1) for _ in range(k)], i % k if label is None else label) for i in range(n)]
    return spark.createDataFrame(rows, "id long, features array<double>, teacher_logits array<double>, label int")


def test_students_fitted_together_equal_students_fitted_alone(spark):
    task = _task(spark)
    specs = (ft.StudentSpec("a", (0, 1, 2, 3)), ft.StudentSpec("b", (1, 3)), ft.StudentSpec("c", (0,)))
    summary, hist = ft.distil_control(task, specs, iters=4)
    for s in specs:
        sub = ft.select_features(task, "features", s.features)
        _, alone = ft.distil_linear(sub, "x_sub", "teacher_logits", "label", iters=4)
        want = [r.loss for r in alone.orderBy("step").collect()]
        got = [r.loss for r in hist.where(F.col("run") == f"control/{s.name}").orderBy("step").collect()]
        assert got == pytest.approx(want)
    assert [r.student for r in summary.orderBy("stage").collect()] == ["a", "b", "c"]


def test_control_reads_its_input_once_a_step(spark, monkeypatch):
    steps = []
    real = ft._partials
    monkeypatch.setattr(ft, "_partials", lambda *a: steps.append(1) or real(*a))
    ft.distil_control(_task(spark), (ft.StudentSpec("a", (0, 1)), ft.StudentSpec("b", (2,))), iters=3)
    assert len(steps) == 4


@pytest.mark.parametrize("label", [-1, 3, None])
def test_labels_outside_the_classes_raise(spark, label):
    rows = [(0, [1.0], [0.0, 1.0, 2.0], 1), (1, [1.0], [0.0, 1.0, 2.0], label)]
    df = spark.createDataFrame(rows, "id long, features array<double>, teacher_logits array<double>, label int")
    with pytest.raises(Exception, match="outside the classes"):
        ft.distil_linear(df, "features", "teacher_logits", "label", iters=1)


def test_fits_of_an_empty_table(spark):
    empty = _task(spark).limit(0)
    weights, hist = ft.distil_linear(empty, "features", "teacher_logits", "label", iters=2)
    assert weights["W"].shape == (0, 0) and hist.collect() == []
    for run in (ft.distil_control, ft.distil_cascade):
        summary, hist = run(empty, (ft.StudentSpec("a", (0,)), ft.StudentSpec("b", (1,))), iters=2)
        assert [(r.student, r.final_loss, r.train_accuracy) for r in summary.orderBy("stage").collect()] == [("a", None, None), ("b", None, None)]
        assert hist.collect() == []


@pytest.mark.parametrize("class_block,row_block", [(2, 7), (1, 1000), (100, 3)])
def test_sharded_weights_take_the_same_steps(spark, class_block, row_block):
    task = _task(spark, n=40, k=5, d=3).repartition(3)
    weights, hist = ft.distil_linear(task, "features", "teacher_logits", "label", iters=3)
    table, sharded = fs.distil_linear_sharded(task, "features", "teacher_logits", "label", iters=3, class_block=class_block, row_block=row_block)
    losses = lambda h: [r.loss for r in h.orderBy("step").collect()]
    assert losses(sharded) == pytest.approx(losses(hist))
    rows = table.orderBy("class").collect()
    assert np.array([r.w for r in rows]) == pytest.approx(weights["W"]) and [r.b for r in rows] == pytest.approx(weights["b"].tolist())


def test_sharded_fit_edges(spark):
    weights, hist = fs.distil_linear_sharded(_task(spark).limit(0), "features", "teacher_logits", "label", iters=2)
    assert weights.collect() == [] and hist.collect() == []
    with pytest.raises(Exception, match="outside the classes"):
        fs.distil_linear_sharded(_task(spark, n=3, label=7), "features", "teacher_logits", "label", iters=1)


def test_encode_keeps_tokens_in_arrow(spark):
    """No token becomes a Python object: a worker's memory is Arrow's buffers, whatever a batch holds."""
    vocab = spark.createDataFrame([("<unk>", 0), ("<eos>", 1), ("a", 2), ("b", 3)], "token string, id int")
    rows = [(0, "a b zz"), (1, None), (2, ""), (3, "b"), (4, None), (5, "ß a")]
    got = {r.k: r.input_ids for r in tk.encode(spark.createDataFrame(rows, "k int, t string").coalesce(1), "t", vocab).collect()}
    assert got == {0: [2, 3, 0], 1: None, 2: [], 3: [3], 4: None, 5: [0, 2]}

    import pyarrow as pa
    words = pa.array([["a", "b"], None, ["zz"], []])[1:]           # a slice: offsets don't begin at 0
    holder = type("Held", (), {"value": (["a", "b"], [2, 3])})
    ids = tk._lookup_udf(holder, "test-arrow", 9).func(words)
    assert isinstance(ids, pa.Array) and ids.to_pylist() == [None, [9], []]
    twice = type("Held", (), {"value": (["a", "a"], [2, 3])})
    with pytest.raises(ValueError):
        tk._lookup_udf(twice, "test-arrow-twice", 9).func(words)


@pytest.mark.parametrize("batched", [True, False])
def test_map_rows_hands_over_small_pieces(spark, batched):
    """However large an Arrow batch is, a user's function sees at most ``batch_size`` rows, fewer where they are long."""
    from kdframe.operators import udf
    rows = spark.range(2500).coalesce(1).select("id", F.when(F.col("id") < 4, F.repeat(F.lit("x"), 3 << 20)).otherwise("y").alias("t"))

    def sizes(x):
        return x.assign(n=len(x))[["id", "n"]] if batched else {"id": x["id"], "n": 1}
    got = udf.map_rows(rows, sizes, "id long, n long", batched=batched).collect()
    assert [r.id for r in got] == list(range(2500))
    if batched:
        # a row of 3 MB is a piece, then come 1000, 1000 and what is left
        assert [r.n for r in got[:4]] == [1, 1, 1, 1] and sorted({r.n for r in got}) == [1, 496, 1000]


def test_generations_move_texts_only_where_shown(spark, tmpdir_path):
    """Rows of the kinds without a text meet their document without it; copies of a document still count for every kind."""
    from kdframe.sources import fixtures as fx
    docs = [(i, f"text {i}\nlast {i}") for i in range(9)] + [(3, "text 3\nlast 3"), (None, "lost")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    items = spark.createDataFrame([(i, f"answer {i}") for i in (*range(-3, 14), None)], "item_id long, answer string")
    gens = fx.generations(spark, tmpdir_path, items, "GSM8K")
    got = sorted(((r.model, r.shot, r.item_id, r.generation) for r in gens.collect()), key=repr)
    texts, want = {}, []
    for k, t in docs:
        texts.setdefault(k, []).append(t)
    for i in (*range(-3, 14), None):
        for m, model in enumerate(fx.MODELS):
            for shot, n in (("0-shot", 0), ("1-shot", 1), ("3-shot", 3)):
                rem = lambda x, y: None if i is None else int(math.fmod(x, y))
                at, kind = rem((i or 0) * 7 + n * 3 + m, len(docs)), rem((i or 0) + n + m, 7)
                for t in [None] if at is None else texts.get(at, [None]):
                    lead = None if t is None else f"The answer is ({chr(65 + int(math.fmod(i, 4)))}). {t}"
                    text = {0: lead, 2: f"so it is: answer {i}", 3: f"1,0 and answer {i}\nA: 99999", 4: f"-answer {i} and -0"}.get(kind, t)
                    if kind == 5:
                        text = f"my choice {chr(97 + int(math.fmod(i, 4)))}x is this"
                    want.append((model, shot, i, text))
    assert got == sorted(want, key=repr)
    # texts are paired by the document and the flag, and the grid is not dealt round-robin before
    joins = [x for x in gens._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 1 and "_whole" in joins[0]


def test_answer_extraction_reads_each_text_once(spark):
    """No regex runs over a whole text to strip it or to list its integers, and a text is taken apart into words in one place."""
    from kdframe.functions import text as tx
    df = spark.createDataFrame([("x", ["a"])], "g string, ch array<string>").repartition(2)
    plan = lambda c: df.select(c.alias("o"))._jdf.queryExecution().analyzed().toString().lower()
    assert "regexp" not in plan(tx.py_strip("g"))
    assert "regexp_extract_all" not in plan(tx.extract_last_integer("g"))
    words = plan(tx.match_choice_by_text("g", "ch"))
    assert words.count("array_intersect") == 1 and "array_union" not in words
    cases = [("--007, and 1,2", "12"), ("x -0", "0"), ("-00", "0"), ("5-06", "-6"), ("3--4z", "-4"), ("-", None), ("", None), (None, None),
             ("1,000,-2,0", "-20"), ("٣ 4²", "4"), ("0", "0"), ("-10", "-10")]
    got = spark.createDataFrame(cases, "t string, want string").select("want", tx.extract_last_integer("t").alias("o")).collect()
    assert all(r.o == r.want for r in got), got
    strips = [(" \n a b \x85 \x1c", "a b"), ("\n　", ""), ("", ""), ("a", "a"), ("​", "​")]
    got = spark.createDataFrame(strips, "t string, want string").select("want", tx.py_strip("t").alias("o")).collect()
    assert all(r.o == r.want for r in got), got
