"""§2.1 sources, splits and sampling over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ordering as od
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources.readers import read_choices, read_dataset, read_with_fallback, table
from ..sources.sinks import CSV_OPTIONS
from .registry import register
from .sqlparts import SHAREGPT, md5_key

SEED = 42


@register("read_dataset", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_dataset(spark, d):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    return read_dataset(spark, f"{d}/conversations.parquet", "parquet", schema)


def _written_as(spark, d, df, fmt, **options):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{fmt}-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(path)
    return path


CONV_SQL = "SELECT conv_id, turn, role, text FROM conversations"
CONV_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


@register("read_dataset_json", CONV_SQL)
def q_read_dataset_json(spark, d):
    """The conversations written as JSON lines and read back."""
    return read_dataset(spark, _written_as(spark, d, q_read_dataset(spark, d), "json"), "json", CONV_SCHEMA)


@register("read_dataset_csv", CONV_SQL)
def q_read_dataset_csv(spark, d):
    """The conversations, line breaks included, written as CSV and read back."""
    path = _written_as(spark, d, q_read_dataset(spark, d), "csv", **CSV_OPTIONS)
    return read_dataset(spark, path, "csv", CONV_SCHEMA, multiLine=True)


@register("read_choices", f"""
SELECT item_id, question, answerKey, array_to_string(choices.text, '|') AS texts, array_to_string(choices.label, '') AS labels FROM ({fx.ARC_SQL})""")
def q_read_choices(spark, d):
    """Items as JSON lines, every third with its choices as a bare list, read into one shape."""
    items = fx.arc_items(spark, d)
    one, other = items.where("item_id % 3 = 0").withColumn("choices", F.col("choices.text")), items.where("item_id % 3 <> 0")
    lines = one.select(F.to_json(F.struct("*")).alias("value")).unionByName(other.select(F.to_json(F.struct("*")).alias("value")))
    read = read_choices(spark, _written_as(spark, d, lines, "text"))
    return read.select("item_id", "question", "answerKey", F.array_join("choices.text", "|").alias("texts"), F.array_join("choices.label", "").alias("labels"))


@register("split_slice", """
SELECT doc_id, idx, n_chars FROM (
  SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
WHERE idx < (SELECT round_even(count(*) * 5 / 100.0, 0) FROM documents)""")
def q_split_slice(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return od.split_slice(docs, "train[:5%]", ["doc_id"]).select("doc_id", "idx", "n_chars")


@register("read_with_fallback", """
SELECT doc_id AS item_id, text AS question FROM (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 100""")
def q_read_with_fallback(spark, d):
    def primary():
        return spark.read.parquet(f"{d}/gsm8k_train.parquet")          # absent: the guarded case

    def fallback():
        return od.split_slice(table(spark, d, "documents"), "train[:100]", ["doc_id"], name=None)

    df = read_with_fallback(primary, fallback)
    return df.select(F.col("doc_id").alias("item_id"), F.col("text").alias("question"))


@register("seeded_shuffle", f"""
SELECT doc_id, row_number() OVER (ORDER BY {md5_key(SEED, 'doc_id')}, doc_id) - 1 AS idx FROM documents""")
def q_seeded_shuffle(spark, d):
    return od.seeded_shuffle(table(spark, d, "documents").select("doc_id"), "doc_id", SEED).select("doc_id", "idx")


@register("sample_n", f"""
SELECT doc_id, n_chars FROM documents ORDER BY {md5_key(SEED, 'doc_id')}, doc_id LIMIT 100""")
def q_sample_n(spark, d):
    return od.sample_n(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 100, SEED).select("doc_id", "n_chars")


@register("head_then_shuffle", f"""
SELECT doc_id, row_number() OVER (ORDER BY {md5_key(SEED, 'doc_id')}, doc_id) - 1 AS idx
FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200)""")
def q_head_then_shuffle(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return od.head_then_shuffle(docs, ["doc_id"], "doc_id", 200, SEED).select("doc_id", "idx")


@register("bounded_head", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 50")
def q_bounded_head(spark, d):
    return od.bounded_head(table(spark, d, "benchmark"), ["item_id"], 50).select("item_id", "text")


@register("train_test_split", f"""
SELECT conv_id, CASE WHEN rn < (SELECT ceil(0.1 * count(*)) FROM ({SHAREGPT})) THEN 'test' ELSE 'train' END AS split
FROM (SELECT conv_id, row_number() OVER (ORDER BY {md5_key(SEED, 'conv_id')}, conv_id) - 1 AS rn FROM ({SHAREGPT}))""")
def q_train_test_split(spark, d):
    return od.train_test_split(fx.sharegpt(spark, d), "conv_id", 0.1, SEED).select("conv_id", "split")


@register("global_index", """
SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS idx FROM documents""")
def q_global_index(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return od.global_index(docs, ["lang", "doc_id"]).select("doc_id", "lang", "idx")


@register("epoch_batches", f"""
SELECT conv_id, epoch, pos, pos // 2 AS batch_id, pos // 8 AS step FROM (
  SELECT conv_id, e.epoch,
         row_number() OVER (PARTITION BY e.epoch ORDER BY {md5_key(SEED, 'e.epoch', 'conv_id')}, conv_id) - 1 AS pos
  FROM (SELECT DISTINCT conv_id FROM conversations) c, range(3) e(epoch))""")
def q_epoch_batches(spark, d):
    convs = table(spark, d, "conversations").select("conv_id").distinct()
    return od.epoch_batches(convs, "conv_id", epochs=3, batch_size=2, grad_accum=4, seed=SEED).select(
        "conv_id", "epoch", "pos", "batch_id", "step")
