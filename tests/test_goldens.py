"""Hand-computed golden values (FIXTURES.md) for the column expressions and operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kdframe.functions import arrays as ar
from kdframe.functions import scores as sc
from kdframe.functions import text as tx
from kdframe.functions.chat import dpo_completion, render_chatml, sharegpt_to_messages
from kdframe.operators import distill as ds
from kdframe.operators import evaluation as ev
from kdframe.operators import fit as ft
from kdframe.operators import hidden as hd
from kdframe.operators import preference as pf
from kdframe.operators import sequences as sq
from kdframe.sources.readers import literal_table


def one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def arr(spark, a, b=None):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>")


@pytest.mark.parametrize("t, s, T, scale, expected", [
    ([3.0, 2.0, 1.0], [1.0, 2.0, 3.0], 2.0, 4.0, 1.2806266713),
    ([3.0, 2.0, 1.0], [1.0, 2.0, 3.0], 1.0, 1.0, 1.1504207652),
])
def test_kl(spark, t, s, T, scale, expected):
    df = arr(spark, s, t)
    assert df.select(sc.kl_row("a", "b", T) * scale).first()[0] == pytest.approx(expected, abs=1e-9)


def test_kl_vocab_policies(spark):
    df = arr(spark, [1.0, 2.0], [3.0, 2.0, 1.0])
    s, t = sc.pad_vocab("a", "b")
    assert df.select(sc.kl_row(s, t, 2.0) * 4).first()[0] == pytest.approx(0.3985690107, abs=1e-9)
    s, t = sc.truncate_vocab("a", "b")
    assert df.select(sc.kl_row(s, t, 1.0)).first()[0] == pytest.approx(0.4621171573, abs=1e-9)


def test_kl_identical_is_zero(spark):
    df = arr(spark, [0.3, -1.0, 5.0, 2.0], [0.3, -1.0, 5.0, 2.0])
    assert df.select(sc.kl_row("a", "b", 2.0)).first()[0] == pytest.approx(0.0, abs=1e-12)


def test_batchmean_divides_by_examples(spark):
    rows = [(0, 0, 0, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), (0, 0, 1, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]),
            (0, 1, 0, [3.0, 2.0, 1.0], [1.0, 2.0, 3.0]), (0, 1, 1, [3.0, 2.0, 1.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "batch_id long, example_id long, pos int, s array<double>, t array<double>")
    kd = ds.batch_kd(df, 2.0).first()["kd"]
    assert kd == pytest.approx(2.5612533426, abs=1e-9)


def test_alpha_mix(spark):
    kd = spark.createDataFrame([(0, 1.2)], "batch_id long, kd double")
    ce = spark.createDataFrame([(0, 2.0)], "batch_id long, ce double")
    assert ds.mix_loss(kd, ce, 0.5).first()["loss"] == pytest.approx(1.6)
    assert ds.mix_loss(kd, None, 0.5).first()["loss"] == pytest.approx(0.6)


def test_selective_log_softmax_and_wpo_adjust(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "l array<double>, y int")
    assert df.select(sc.selective_log_softmax("l", "y")).first()[0] == pytest.approx(-0.4076059644, abs=1e-9)
    assert df.select(sc.wpo_adjust("l")).first()[0] == pytest.approx(-0.6722803004, abs=1e-9)


def test_dpo_loss(spark):
    df = spark.createDataFrame([(1, -10.0, -14.0, -11.0, -13.0)],
                               "pair_id long, chosen double, rejected double, ref_chosen double, ref_rejected double")
    r = pf.reward_accuracy(pf.dpo_loss(df, 0.1)).first()
    assert r["loss"] == pytest.approx(0.5981388694, abs=1e-9)
    assert r["chosen_reward"] == pytest.approx(0.1) and r["rejected_reward"] == pytest.approx(-0.1)
    assert r["margin"] == pytest.approx(0.2) and r["reward_accuracy"] == 1.0


def test_dpo_loss_stable_for_large_margins(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, -5000.0), (2, 0.0, 0.0, -5000.0, 0.0)],
                               "pair_id long, chosen double, rejected double, ref_chosen double, ref_rejected double")
    got = {r["pair_id"]: r["loss"] for r in pf.dpo_loss(df, 0.1).collect()}
    assert got[1] == pytest.approx(500.0) and got[2] == pytest.approx(0.0, abs=1e-12)


def test_response_mse(spark):
    df = spark.createDataFrame([(0, -10.0, -11.0), (0, -14.0, -13.5)], "batch_id long, student_chosen double, teacher_chosen double")
    assert ds.response_kd_mse(df).first()["mse"] == pytest.approx(0.625)


@pytest.mark.parametrize("S, T, expected", [
    (24, 28, [0, 1, 2, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 18, 19, 20, 21, 22, 23, 25, 26, 27]),
    (12, 28, [0, 2, 5, 7, 10, 12, 15, 17, 20, 22, 25, 27]),
])
def test_layer_map(spark, S, T, expected):
    got = [r["teacher_layer"] for r in hd.layer_map(spark, S, T).orderBy("student_layer").collect()]
    assert got == expected


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()] == [0.0, 2.0, 2.0]


def test_flush_left(spark):
    rows = [(0, 0, [0, 0, 1, 1, 1], [9, 9, 2, 3, 4], [0, 0, 0, 1, 1]),
            (0, 1, [0, 1, 1, 0, 0], [9, 5, 6, 9, 9], [0, 0, 1, 0, 0])]
    df = spark.createDataFrame(rows, "batch_id long, row long, attention_mask array<int>, input_ids array<int>, loss_mask array<int>")
    out = {r["row"]: r for r in sq.flush_left(df).collect()}
    assert out[0]["attention_mask"] == [1, 1, 1] and out[1]["attention_mask"] == [1, 1, 0]
    assert out[0]["input_ids"] == [2, 3, 4] and out[1]["input_ids"] == [5, 6, 9]


@pytest.mark.parametrize("text, expected", [
    ("x 1,234 y -5.75", "75"), ("3-4", "-4"), ("it's - 5", "5"), ("no", None), (None, None),
    ("007 and -00", "0"), ("12345678901234567890123", "12345678901234567890123"),
])
def test_last_integer(spark, text, expected):
    assert one(spark, tx.extract_last_integer("t"), "t string", (text,)) == expected


@pytest.mark.parametrize("text, expected", [
    ("a dog", "A"), ("The answer is (c).", "C"), ("answer:Cat", "C"), ("choice dog", "D"),
    ("xéa", None), ("", None), (None, None),
])
def test_choice_letter(spark, text, expected):
    assert one(spark, tx.extract_choice_letter("t"), "t string", (text,)) == expected


def test_choice_by_text(spark):
    df = spark.createDataFrame([("the red fox", ["blue sky", "red fox den"]), ("a blue sky day", ["x", "Blue Sky"]),
                                ("", ["a"]), ("zzz", [])], "g string, c array<string>")
    got = [r[0] for r in df.select(tx.match_choice_by_text("g", "c")).collect()]
    assert got == ["B", "B", None, None]


@pytest.mark.parametrize("text, expected", [("x\nA: y\nQ: z", "x"), ("\n a \t", "a"), (None, ""), ("", ""),
                                            (" ok\nQuestion: q", "ok")])
def test_truncate_at_stop(spark, text, expected):
    assert one(spark, tx.truncate_at_stop("t"), "t string", (text,)) == expected


def _conv(spark, turns):
    return spark.createDataFrame([(turns,)], "c array<struct<from:string,value:string>>")


def test_system_turns_reversed(spark):
    df = _conv(spark, [("human", "h"), ("system", "s1"), ("system", "s2")])
    m = df.select(sharegpt_to_messages("c").alias("m")).first()["m"]
    assert [(x["role"], x["content"]) for x in m] == [("system", "s2"), ("system", "s1"), ("user", "h")]


def test_default_system_and_chatml(spark):
    df = _conv(spark, [("human", "h"), ("tool", "dropped")])
    m = df.select(sharegpt_to_messages("c").alias("m")).first()["m"]
    assert [(x["role"], x["content"]) for x in m] == [("system", "You are a helpful assistant."), ("user", "h")]
    text = df.select(render_chatml(sharegpt_to_messages("c"), True)).first()[0]
    assert text == ("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nh<|im_end|>\n"
                    "<|im_start|>assistant\n")


def test_chatml_default_block_when_first_is_not_system(spark):
    df = spark.createDataFrame([([("user", "u")],)], "m array<struct<role:string,content:string>>")
    assert df.select(render_chatml("m", False)).first()[0] == (
        "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nu<|im_end|>\n")


def test_dpo_suffix(spark):
    assert one(spark, dpo_completion("t"), "t string", ("ok",)) == "ok<|im_end|>n"


def test_keep_end_start(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "a array<int>")
    r = df.select(ar.keep_end("a", 3).alias("e"), ar.keep_start("a", 3).alias("s")).first()
    assert r["e"] == [2, 3, 4] and r["s"] == [1, 2, 3]
    with pytest.raises(ValueError):
        ar.truncate_seq("a", 3, "middle")


def test_pack_position_ids(spark):
    rows = [(0, 0, [1, 2, 3, 0], [1, 1, 1, 0], [0, 1, 1, 0]), (0, 1, [4, 5, 6, 7], [1, 1, 1, 1], [0, 0, 1, 1])]
    df = spark.createDataFrame(rows, "batch_id long, row long, input_ids array<int>, attention_mask array<int>, loss_mask array<int>")
    p = sq.pack_padding_free(df).first()
    assert p["position_ids"] == [0, 1, 2, 0, 1, 2, 3] and p["input_ids"] == [1, 2, 3, 4, 5, 6, 7]
    back = {r["row"]: r["input_ids"] for r in sq.unpack_padding_free(sq.pack_padding_free(df), df).collect()}
    assert back == {0: [1, 2, 3, 0], 1: [4, 5, 6, 7]}


def test_cascade_plan(spark):
    st = literal_table(spark, [(1, "s1"), (2, "s2"), (3, "s3")], "stage int, student string")
    rows = ft.run_plan(st, "T").where("mode = 'cascade'").orderBy("stage").collect()
    assert [(r["teacher"], r["student"]) for r in rows] == [("T", "s1"), ("s1", "s2"), ("s2", "s3")]
    ctl = ft.run_plan(st, "T").where("mode = 'control'").collect()
    assert {r["teacher"] for r in ctl} == {"T"}


def test_demo_block(spark):
    train = spark.createDataFrame([(1, "q1", "a1"), (2, "q2", "a2")], "item_id long, question string, answer string")
    block = ev.gsm_demo_block(train, 2, 42).first()
    order = sorted([1, 2], key=lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i))
    expect = "\n".join(f"Question: q{i}\nAnswer: a{i}\n" for i in order)
    assert block["demos"] == expect and block["n_demos"] == 2
    assert ev.gsm_demo_block(train, 0, 42).first()["demos"] == ""


def test_empty_accuracy_group(spark):
    scored = spark.createDataFrame([("m", "GSM8K", "0-shot", True)], "model string, dataset string, shot string, correct boolean")
    grid = spark.createDataFrame([("m", "GSM8K", "0-shot"), ("m", "GSM8K", "1-shot")], "model string, dataset string, shot string")
    got = {r["shot"]: (r["accuracy"], r["num"]) for r in ev.accuracy_summary(scored, grid).collect()}
    assert got == {"0-shot": (1.0, 1), "1-shot": (0.0, 0)}


def test_arc_answer_text(spark):
    rows = [(1, "q", (["x", "y"], ["A", "B"]), "B"), (2, "q", (["x", "y"], ["A", "B"]), "Z"),
            (3, "q", (["x"], ["A"]), ""), (4, "q", ([], []), "K ")]
    df = spark.createDataFrame(rows, "item_id long, question string, choices struct<text:array<string>,label:array<string>>, answerKey string")
    got = {r["item_id"]: r["a"] for r in df.select("item_id", ev.arc_answer_text().alias("a")).collect()}
    assert got == {1: "y", 2: "x", 3: "x", 4: "K"}


def test_format_choices(spark):
    df = spark.createDataFrame([(["x", "y"],)], "c array<string>")
    assert df.select(tx.format_choices("c")).first()[0] == "A) x\nB) y"


def test_masked_kd_drops_padding_positions(spark):
    rows = [(0, 0, 0, 1, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), (0, 0, 1, 0, [9.0, 0.0, 0.0], [0.0, 0.0, 9.0])]
    df = spark.createDataFrame(rows, "batch_id long, example_id long, pos int, m int, s array<double>, t array<double>")
    masked = ds.batch_kd(df, 2.0, mask=F.col("m") == 1).first()["kd"]
    assert masked == pytest.approx(1.2806266713, abs=1e-9)
    assert ds.batch_kd(df, 2.0).first()["kd"] > masked


def test_eval_metrics_prefix(spark):
    pairs = spark.createDataFrame([(0, 1, -10.0, -14.0, -11.0, -13.0)],
                                  "batch_id long, pair_id long, chosen double, rejected double, ref_chosen double, ref_rejected double")
    per_pair = pf.reward_accuracy(pf.dpo_loss(pairs, 0.1))
    per_batch = spark.createDataFrame([(0, 1.5, -0.5, 0.01)], "batch_id long, mean_chosen_logits double, mean_rejected_logits double, kd double")
    got = {r["metric"]: r["value"] for r in pf.preference_metrics(per_pair, per_batch, train_eval="eval").collect()}
    assert set(got) == {"eval_" + m for m in pf.METRICS}
    assert got["eval_rewards/margins"] == pytest.approx(0.2) and got["eval_logits/kd"] == pytest.approx(0.01)
