"""The preference flow from text pairs to metrics: every field of its configuration does what it says."""

import pytest
from pyspark.sql import functions as F

from kdframe.config import DPOConfig
from kdframe.operators import tokens as tk
from kdframe.plans import flows
from kdframe.sources import fixtures as fx
from kdframe.sources.readers import table

from .conftest import SF001

IDS = 64


@pytest.fixture(scope="module")
def inputs(spark):
    pairs = fx.dpo_pairs(spark, SF001).withColumn("chosen", F.substring("chosen", 1, 80)).withColumn("rejected", F.substring("rejected", 1, 60)).cache()
    return pairs, tk.fit_vocab(table(spark, SF001, "documents"), "text", IDS).cache()


def batch():
    return F.floor(F.col("pair_id") / (fx.CONVS_PER_BATCH * fx.PAIR_STRIDE)).cast("long")


def sequences(inputs, cfg):
    return {(r.pair_id, r.side): r for r in flows.preference_sequences(*inputs, cfg, 1, batch()).collect()}


def test_split_is_exact_and_batches_are_of_one_split(inputs):
    pairs, _ = inputs
    n = pairs.count()
    none = sequences(inputs, DPOConfig(val_split=0.0))
    assert len(none) == 2 * n and not any(r.is_eval for r in none.values())
    half = sequences(inputs, DPOConfig(val_split=0.5))
    assert len({k for k, r in half.items() if r.is_eval}) == 2 * -(-n // 2)
    assert all(r.is_eval == (r.batch_id % 2 == 1) for r in half.values())


def test_truncation_keeps_the_end_or_the_start(inputs):
    whole, end, start = (sequences(inputs, DPOConfig(max_length=m, truncation_mode=t)) for m, t in
                         ((None, "keep_end"), (20, "keep_end"), (20, "keep_start")))
    for k, r in whole.items():
        assert end[k].input_ids == r.input_ids[-20:] and start[k].input_ids == r.input_ids[:20]
        assert end[k].loss_mask == r.loss_mask[-20:] and start[k].attention_mask == r.attention_mask[:20]
        assert r.labels == r.input_ids[1:] + r.input_ids[:1] and r.label_mask == r.loss_mask[1:] + r.loss_mask[:1]
    with pytest.raises(ValueError):
        sequences(inputs, DPOConfig(max_length=20, truncation_mode="middle"))


def test_suffix_ends_the_completions(spark, inputs):
    pairs, _ = inputs
    vocab = spark.createDataFrame([("<unk>", 0), ("<eos>", 1), ("STOP", 2)], "token string, id int")
    for suffix, last in ((" STOP", 2), (" other", 0)):
        rows = {(r.pair_id, r.side): r for r in flows.preference_sequences(pairs, vocab, DPOConfig(suffix=suffix), 1, batch()).collect()}
        for r in rows.values():
            assert [i for i, m in zip(r.input_ids, r.loss_mask) if m][-1] == last


def test_flow_metrics_by_split_and_option(inputs):
    score = lambda t: fx.id_scores(t, IDS)
    base = flows.preference_flow(*inputs, score, DPOConfig(val_split=0.5, max_length=24), batch()).collect()
    assert all(r.metric.startswith("eval_") == (r.batch_id % 2 == 1) for r in base)
    assert {r.metric.removeprefix("eval_") for r in base} >= {"loss", "logits/kd", "rewards/margins", "logps/chosen"}
    rpo = flows.preference_flow(*inputs, score, DPOConfig(val_split=0.0, max_length=24, rpo_alpha=0.5), batch()).collect()
    values = {(r.batch_id, r.metric): r.value for r in rpo}
    plain = {(r.batch_id, r.metric): r.value for r in flows.preference_flow(*inputs, score, DPOConfig(val_split=0.0, max_length=24), batch()).collect()}
    for b in {k[0] for k in values}:
        assert values[(b, "loss")] == pytest.approx(plain[(b, "loss")] + 0.5 * values[(b, "nll_loss")])
