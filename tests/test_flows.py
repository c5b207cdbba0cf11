"""The three end-to-end flows."""

from pyspark.sql import functions as F

from kdframe.config import DistillConfig
from kdframe.plans import flows

from .conftest import SF001


def test_chat_kd_dataset(spark):
    df = flows.chat_kd_dataset(spark, SF001, vocab_size=512, max_length=64)
    assert flows.chat_kd_dataset(spark, SF001, 512, DistillConfig(max_length=32)).first()["input_ids"].__len__() == 32
    r = df.first()
    assert len(r["input_ids"]) == 64 and len(r["attention_mask"]) == 64
    assert df.select(F.max("n_tokens")).first()[0] <= 64
    assert {x["split"] for x in df.select("split").distinct().collect()} == {"train", "test"}


def test_preference_batches(spark):
    m = flows.preference_batches(spark, SF001)
    names = {r["metric"] for r in m.select("metric").distinct().collect()}
    assert {"rewards/chosen", "rewards/accuracies", "logits/kd", "loss"} <= names


def test_reasoning_eval(spark):
    def echo(prompts):
        return ["The answer is (B). 42" for _ in prompts]
    detail, summary, pivot = flows.reasoning_eval(spark, SF001, ["m1", "m2"], echo, n_items=5)
    assert summary.count() == 2 * 2 * 3
    assert detail.count() == 2 * 3 * (5 + 5)
    assert set(pivot.columns) == {"dataset", "model", "0-shot", "1-shot", "3-shot"}


def test_entry_is_deterministic(spark):
    import __spark_entry__ as entry
    a = {(r["conv_id"], r["split"], r["n_tokens"]) for r in entry.entry(spark).collect()}
    b = {(r["conv_id"], r["split"], r["n_tokens"]) for r in entry.entry(spark).collect()}
    assert a == b and len(a) == 20
