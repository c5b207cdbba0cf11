"""Goldens of the cases that a value check over the given tables cannot see."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kdframe.config import DPOConfig, EvalConfig
from kdframe.functions import scores as sc
from kdframe.functions import text as tx
from kdframe.operators import distill as ds
from kdframe.operators import evaluation as ev
from kdframe.operators import fit as ft
from kdframe.operators import preference as pf
from kdframe.operators.patterns import pattern_flag, read_patterns
from kdframe.plans.flows import reasoning_eval
from kdframe.sources import fixtures as fx
from kdframe.sources import sinks

from .conftest import SF001


@pytest.mark.parametrize("label", [3, -2])
def test_label_outside_the_vocabulary_is_an_error(spark, label):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], label)], "logits array<double>, label int")
    with pytest.raises(Exception, match="outside the vocabulary"):
        df.select(sc.selective_log_softmax("logits", "label")).collect()
    ok = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([1.0], None), (None, 0)], "logits array<double>, label int")
    assert [r[0] and round(r[0], 10) for r in ok.select(sc.selective_log_softmax("logits", "label")).collect()] == [-0.4076059644, None, None]


def test_masked_example_stays_in_the_denominator(spark):
    rows = [(0, 0, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0], 1), (0, 1, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "batch_id int, example_id int, s array<double>, t array<double>, m int")
    assert ds.batch_kd(df, 2.0, mask=F.col("m") == 1).first()["kd"] == pytest.approx(1.2806266713 / 2)
    assert ds.kd_loss_debug(df, mask=F.col("m") == 1).first()["kd"] == pytest.approx(1.1504207652 / 2)


@pytest.mark.parametrize("text,letter", [("answer:\x0bCat", "C"), ("choice dog", "D"), ("Answer :  bee", "B"), ("choice-dog", None), (None, None)])
def test_keyword_letter_over_unicode_space(spark, text, letter):
    assert spark.createDataFrame([(text,)], "t string").select(tx.extract_choice_letter("t")).first()[0] == letter


def test_prompts_with_few_or_no_demos(spark):
    test = spark.createDataFrame([(1, "q", (["x", "y"], ["A", "B"]))], "item_id int, question string, choices struct<text:array<string>,label:array<string>>")
    demos = lambda t, n: spark.createDataFrame([(t, n)], "demos string, n_demos int")
    one = ev.few_shot_prompt_arc(test, demos("loop", 1), 3, fallback=demos("built", 1)).first()["prompt"]
    full = ev.few_shot_prompt_arc(test, demos("loop", 3), 3, fallback=demos("built", 3)).first()["prompt"]
    none = ev.few_shot_prompt_arc(test, demos("", 0), 3, fallback=demos("", 0)).first()["prompt"]
    tail = "Question: q\nA) x\nB) y\nAnswer:"
    assert (one, full, none) == ("built\n" + tail, "loop\n" + tail, tail)
    assert ev.few_shot_prompt_gsm(test, demos("", 0), 3, fallback=demos("", 0)).first()["prompt"] == "Question: q\nAnswer:"


def test_csv_values_survive(spark, tmpdir_path):
    import pandas as pd
    text = ' lead "quoted" text, x\nline2 '
    rows = spark.createDataFrame([("m", "d", "s", 1, text, ["a,b", '"']), ("m", "d", "s", 2, "", [])],
                                 "model string, dataset string, shot string, item_id int, generation string, choices array<string>")
    path = os.path.join(tmpdir_path, "csv")
    sinks.write_eval_csv(rows, path)
    back = sinks.read_csv(spark, path, "item_id int, generation string, choices string, model string, dataset string, shot string")
    assert {r.item_id: (r.generation or "", r.choices) for r in back.collect()} == {1: (text, '["a,b","\\""]'), 2: ("", "[]")}
    folder = os.path.join(path, "model=m", "dataset=d", "shot=s")
    frame = pd.concat([pd.read_csv(os.path.join(folder, f), keep_default_na=False) for f in os.listdir(folder) if f.endswith(".csv")])
    assert set(frame["generation"]) == {text, ""}


def test_fit_log_is_a_list_and_kept_after_a_failure(spark, tmpdir_path, monkeypatch):
    import json
    task = fx.linear_task(spark, SF001)
    calls = []
    real = ft._partials

    def failing(*a):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*a)
    monkeypatch.setattr(ft, "_partials", failing)
    path = os.path.join(tmpdir_path, "log")
    with pytest.raises(RuntimeError):
        ft.distil_and_log(task, "features", "teacher_logits", "label", path, iters=5)
    log = json.loads(spark.read.text(path, wholetext=True).first()[0])
    assert [r["step"] for r in log] == [0, 1] and log[0]["loss"] > log[1]["loss"]


def test_gradient_sum_does_not_depend_on_partitions(spark):
    task = fx.linear_task(spark, SF001).cache()
    one, _ = ft.distil_linear(task.coalesce(1), "features", "teacher_logits", "label", iters=2)
    many, _ = ft.distil_linear(task.repartition(200), "features", "teacher_logits", "label", iters=2)
    assert np.allclose(one["W"], many["W"], atol=1e-12) and np.allclose(one["b"], many["b"], atol=1e-12)


def test_patterns_from_yaml(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "p.yaml")
    with open(path, "w") as f:
        f.write("other:\n- nope\nunfrozen_parameters:\n- ^ignored.*\n- 'red'\n- \"bo lt\"\n  # note\nmore: 1\n- last\n")
    pats = read_patterns(spark, path)
    assert sorted(r.pattern for r in pats.collect()) == ["^ignored.*", "bo lt", "red"]
    names = spark.createDataFrame([("a red car",), ("bo lt",), ("bolt",), (None,)], "name string")
    assert {r.name: r.flag for r in pattern_flag(names, "name", pats).collect()} == {"a red car": True, "bo lt": True, "bolt": False, None: False}
    assert not any(r.flag for r in pattern_flag(names, "name", pats.limit(0)).collect())


def test_models_generate_for_themselves(spark):
    def generate(prompts, model, max_new_tokens):
        return [f"The answer is ({'A' if model == 'one' else 'B'}). {max_new_tokens}" for _ in prompts]

    detail, summary, _ = reasoning_eval(spark, SF001, ["one", "two"], generate, EvalConfig(gsm_samples=4, arc_samples=8))
    num = {(r.model, r.dataset): r.num for r in summary.where("shot = '0-shot'").collect()}
    assert num == {(m, d): n for m in ("one", "two") for d, n in (("GSM8K", 4), ("ARC-Challenge", 8))}
    right = {(r.model, r.item_id): r.correct for r in detail.where("dataset = 'ARC-Challenge' and shot = '0-shot'").collect()}
    assert any(right["one", i] != right["two", i] for _, i in right)


def test_composed_loss_with_each_option(spark):
    pairs = pf.pair_table(fx.pref_tokens(spark, SF001)).withColumn("aux_loss", F.lit(2.0)).cache()
    base = {r.pair_id: r for r in pf.composed_loss(pairs, DPOConfig(kd_weight=0.0)).collect()}

    def off(cfg, **how):
        return {r.pair_id: r.loss - base[r.pair_id].loss for r in pf.composed_loss(pairs, cfg, **how).collect()}
    for i, d in off(DPOConfig(kd_weight=0.5)).items():
        assert d == pytest.approx(0.5 * base[i].kd)
    for i, d in off(DPOConfig(kd_weight=0.0, rpo_alpha=2.0)).items():
        assert d == pytest.approx(2.0 * base[i].nll_loss)
    for i, d in off(DPOConfig(kd_weight=0.0, aux_loss_coef=0.25)).items():
        assert d == pytest.approx(0.5)
    for i, d in off(DPOConfig(kd_weight=0.0), use_weighting=True).items():
        assert d == pytest.approx(base[i].loss * (base[i].policy_weight - 1))
    names = lambda cfg: {r.metric for r in pf.composed_metrics(pf.composed_loss(pairs, cfg), cfg).collect()}
    assert names(DPOConfig(rpo_alpha=1.0, aux_loss_coef=1.0)) - names(DPOConfig()) == {"nll_loss", "aux_loss"}


def test_each_logit_pair_is_derived_once(spark):
    from kdframe.plans.preference_queries import q_preference_metrics
    plan = q_preference_metrics(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4  # embeddings: scores twice (next row), count, labels
