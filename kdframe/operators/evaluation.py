"""Few-shot evaluation: demo blocks, prompts, the model × item × shot grid, scoring, summaries.

Demo blocks are one-row tables (their size is bounded by the shot count) and are cross-joined
to the item table as a broadcast; the grid is items × (small model list × shot list), also with
broadcast small sides.  Accuracy is a hash aggregate per (model, dataset, shot) left-joined from
the grid so empty groups report 0.0.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import SHOTS, STOP_SEQS
from ..functions.text import (extract_choice_letter, extract_last_integer, format_choices, match_choice_by_text, py_strip,
                              truncate_at_stop, zero_shot_prompt)
from .ordering import sample_n
from ..sources.readers import literal_table


def _one_row_block(rows: DataFrame, text_col: str, n: int, sep: str = "\n") -> DataFrame:
    """Join the (≤ n, already sampled) demo rows in shuffle order into one string."""
    if n <= 0:
        return literal_table(rows.sparkSession, [("", 0)], "demos string, n_demos int")
    agg = rows.agg(F.array_sort(F.collect_list(F.struct("shuffle_key", "item_id", F.col(text_col).alias("t")))).alias("_d"))
    return agg.select(F.array_join(F.transform("_d", lambda x: x["t"]), sep).alias("demos"),
                      F.size("_d").cast("int").alias("n_demos"))


def shot_pool(train: DataFrame, n: int, seed: int = 42, pool_min: int = 50) -> DataFrame:
    """First max(pool_min, n) rows of the seeded shuffle, with their position ``pool_idx``."""
    from .ordering import seeded_shuffle
    # only the pool's rows are indexed, not the whole table
    pool = sample_n(train, "item_id", max(pool_min, n), seed).drop("shuffle_key")
    return seeded_shuffle(pool, "item_id", seed, name="pool_idx")


def gsm_demo_block(train: DataFrame, n: int, seed: int = 42, strip_q: bool = True) -> DataFrame:
    """``Question: q\\nAnswer: a\\n`` for the first n shuffled rows, joined by newlines.  The
    builder strips q and a; the evaluation loop strips only a (``strip_q=False``)."""
    rows = sample_n(train, "item_id", max(n, 0), seed) if n > 0 else train.limit(0).withColumn("shuffle_key", F.lit(""))
    q = py_strip(F.coalesce("question", F.lit(""))) if strip_q else F.coalesce("question", F.lit(""))
    demo = F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), py_strip(F.coalesce("answer", F.lit(""))), F.lit("\n"))
    return _one_row_block(rows.withColumn("_demo", demo), "_demo", n)


def arc_demo_block(train: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Builder form: question, lettered options, ``Answer: key``."""
    rows = sample_n(train, "item_id", max(n, 0), seed) if n > 0 else train.limit(0).withColumn("shuffle_key", F.lit(""))
    demo = F.concat(F.lit("Question: "), py_strip(F.coalesce("question", F.lit(""))), F.lit("\n"),
                    format_choices(F.coalesce(F.col("choices.text"), F.array().cast("array<string>"))),
                    F.lit("\nAnswer: "), F.coalesce("answerKey", F.lit("")), F.lit("\n"))
    return _one_row_block(rows.withColumn("_demo", demo), "_demo", n)


def arc_answer_text(choices_col: str = "choices", key_col: str = "answerKey"):
    """Loop form answer: the choice at the key's index in the labels (key absent → index 0);
    no key or index out of range → first choice; no choices → the key itself."""
    text = F.coalesce(F.col(f"{choices_col}.text"), F.array().cast("array<string>"))
    labels = F.col(f"{choices_col}.label")
    key = F.coalesce(F.col(key_col), F.lit(""))
    pos = F.coalesce(F.array_position(labels, key), F.lit(0))
    idx = F.when(key == "", F.lit(None)).when(pos > 0, pos - 1).otherwise(F.lit(0))
    ct = F.when(idx.isNotNull() & (idx < F.size(text)), F.element_at(text, (idx + 1).cast("int"))).otherwise(
        F.when(F.size(text) > 0, F.element_at(text, 1)).otherwise(F.lit("")))
    return F.when(F.coalesce(ct, F.lit("")) != "", ct).otherwise(py_strip(key))


def arc_demo_block_text(train: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Loop form: ``Question: q\\n{answer text}\\n`` — no options, no ``Answer:``."""
    rows = sample_n(train, "item_id", max(n, 0), seed) if n > 0 else train.limit(0).withColumn("shuffle_key", F.lit(""))
    demo = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\n"), arc_answer_text(), F.lit("\n"))
    return _one_row_block(rows.withColumn("_demo", demo), "_demo", n)


def few_shot_prompt_gsm(test: DataFrame, demos: DataFrame, n: int, fallback: DataFrame | None = None) -> DataFrame:
    """n = 0 → zero-shot; else demos + ``\\nQuestion: q\\nAnswer:``; with fewer demos than n the
    builder block over the available ones (``fallback``) is used."""
    if n == 0:
        return test.withColumn("prompt", zero_shot_prompt("question"))
    d = demos.select("demos", "n_demos")
    if fallback is not None:
        d = d.crossJoin(fallback.select(F.col("demos").alias("_fb")))
    j = test.crossJoin(F.broadcast(d))
    block = F.col("demos") if fallback is None else F.when(F.col("n_demos") < n, F.col("_fb")).otherwise(F.col("demos"))
    shown = F.concat(block, F.lit("\nQuestion: "), F.col("question"), F.lit("\nAnswer:"))
    # without any demo to show the prompt is the zero-shot one
    return j.withColumn("prompt", F.when(F.col("n_demos") == 0, zero_shot_prompt("question")).otherwise(shown)).drop(
        "demos", "n_demos", *(["_fb"] if fallback is not None else []))


def few_shot_prompt_arc(test: DataFrame, demos: DataFrame, n: int, fallback: DataFrame | None = None) -> DataFrame:
    """n = 0 → question + options + ``\\nAnswer:``; else demos first; with fewer demos than n the
    builder block over the available ones (``fallback``) is used, without any the zero-shot form."""
    opts = format_choices(F.coalesce(F.col("choices.text"), F.array().cast("array<string>")))
    tail = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n"), opts, F.lit("\nAnswer:"))
    if n == 0:
        return test.withColumn("prompt", tail)
    d = demos.select("demos", "n_demos")
    if fallback is not None:
        d = d.crossJoin(fallback.select(F.col("demos").alias("_fb")))            # one row each
        d = d.select(F.when(F.col("n_demos") < n, F.col("_fb")).otherwise(F.col("demos")).alias("demos"), "n_demos")
    j = test.crossJoin(F.broadcast(d))
    shown = F.when(F.col("n_demos") == 0, tail).otherwise(F.concat(F.col("demos"), F.lit("\n"), tail))
    return j.withColumn("prompt", shown).drop("demos", "n_demos")


def qa_prompt(test: DataFrame, demos: DataFrame) -> DataFrame:
    """Short form: demos joined by newlines + ``\\nQ: q\\nA:``."""
    j = test.crossJoin(F.broadcast(demos.select("demos")))
    return j.withColumn("prompt", F.concat(F.col("demos"), F.lit("\nQ: "), F.col("question"), F.lit("\nA:"))).drop("demos")


def eval_grid(spark: SparkSession, models: DataFrame, items: DataFrame, shots=SHOTS) -> DataFrame:
    """model × item × shot."""
    sh = literal_table(spark, [(s, n) for s, n in shots], "shot string, n_shot int")
    return items.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(sh))


def score_gsm(gens: DataFrame, items: DataFrame, clean: bool = True) -> DataFrame:
    """gold = last integer of the answer; correct iff both exist and are equal."""
    g = truncate_at_stop("generation") if clean else F.col("generation")
    # both answers are extracted before the join: once a generation and once an item, and a query
    # that wants no texts moves none
    left = gens.select("model", "dataset", "shot", "item_id", g.alias("generation")).withColumn("pred", extract_last_integer("generation"))
    right = items.select("item_id", "question", extract_last_integer("answer").alias("gold"))
    return left.join(right, "item_id", "inner").select(
        "model", "dataset", "shot", "item_id", "question", "gold", "pred",
        F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).alias("correct"), "generation")


def score_arc(gens: DataFrame, items: DataFrame, clean: bool = True) -> DataFrame:
    """pred = letter or text match; correct iff both exist and pred == key.

    The letter is extracted before the join, and only a generation without one takes its text along
    for the match; a query that wants no texts moves no others."""
    g = truncate_at_stop("generation") if clean else F.col("generation")
    left = gens.select("model", "dataset", "shot", "item_id", g.alias("generation")).withColumn("_letter", extract_choice_letter("generation"))
    left = left.withColumn("_open", F.when(F.col("_letter").isNull(), F.col("generation")))
    j = left.join(items.select("item_id", "question", "choices", "answerKey"), "item_id", "inner")
    pred = F.coalesce("_letter", match_choice_by_text("_open", F.col("choices.text")))
    return j.withColumn("pred", pred).select(
        "model", "dataset", "shot", "item_id", "question", F.col("choices.text").alias("choices"), F.col("answerKey").alias("gold"), "pred",
        F.coalesce(F.col("pred") == F.col("answerKey"), F.lit(False)).alias("correct"), "generation")


def accuracy_summary(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """(model, dataset, shot, accuracy, num); groups of the grid without items get 0.0 / 0."""
    agg = scored.groupBy("model", "dataset", "shot").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"),
                                                        F.count("*").alias("num"))
    return grid.join(agg, ["model", "dataset", "shot"], "left").select(
        "model", "dataset", "shot", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("num", F.lit(0)).cast("long").alias("num"))


def accuracy_pivot(summary: DataFrame, shots=None) -> DataFrame:
    """dataset, model × shot columns (sorted); missing → null (NaN in the source)."""
    labels = sorted(shots) if shots is not None else sorted(s for s, _ in SHOTS)
    return summary.groupBy("dataset", "model").pivot("shot", labels).agg(F.first("accuracy"))


def generate_batch(df: DataFrame, fn: Callable[..., list], prompt_col: str = "prompt",
                   out_col: str = "generation", stops=STOP_SEQS, cleanup: bool = True, max_new_tokens: int = 64,
                   max_length: int = 1024, model_col: str | None = None) -> DataFrame:
    """Batch-inference hook: ``fn(list_of_prompts) -> list_of_texts`` runs inside ``mapInPandas``
    on Arrow batches (load the model once per worker inside ``fn``); outputs are stripped and,
    with ``cleanup``, cut at the stop sequences.  ``fn`` owns decoding (greedy; only the continuation
    is returned, see ``strip_prompt`` for id-level outputs).  It is handed what it has parameters
    for: ``max_new_tokens``, ``max_length`` (model tokens kept of a prompt) and, with ``model_col``,
    the ``model`` it serves; prompts of different models come in calls of their own."""
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType())])

    import inspect
    taken = inspect.signature(fn).parameters
    anything = any(p.kind is p.VAR_KEYWORD for p in taken.values())
    given = {k: v for k, v in (("max_new_tokens", max_new_tokens), ("max_length", max_length)) if anything or k in taken}
    with_model = model_col is not None and (anything or "model" in taken)

    def run(batches):
        for pdf in batches:
            parts = [(m, g) for m, g in pdf.groupby(model_col, sort=False, dropna=False)] if with_model else [(None, pdf)]
            for m, g in parts:
                g = g.copy()
                outs = fn(g[prompt_col].fillna("").tolist(), **given, **({"model": m} if with_model else {}))
                g[out_col] = pd.Series(outs, index=g.index, dtype=object)
                yield g

    out = df.mapInPandas(run, schema)
    return out.withColumn(out_col, truncate_at_stop(out_col, stops, cleanup) if cleanup else py_strip(out_col))


def generation_udf(make_generate: Callable[[], Callable[[list], list]], batch_size: int = 64):
    """Column-level inference hook built on ``predict_batch_udf``: ``make_generate()`` loads the
    model once per Python worker and returns ``fn(list_of_prompts) -> list_of_texts``; Spark feeds
    it Arrow batches of ``batch_size`` prompts.  Apply ``truncate_at_stop`` to the result as the
    cleanup step."""
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf

    def make():
        fn = make_generate()

        def predict(prompts):
            return np.array(fn([str(p) for p in prompts]), dtype=object)
        return predict

    return predict_batch_udf(make, return_type=StringType(), batch_size=batch_size)
