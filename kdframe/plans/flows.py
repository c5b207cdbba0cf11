"""End-to-end flows of the three distillation entry points, composed from the operators."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ARC_NAME, GSM_NAME, SEED, DistillConfig, DPOConfig, EvalConfig
from ..operators import evaluation as ev
from ..operators import ordering as od
from ..operators import preference as pf
from ..operators import sequences as sq
from ..operators import tokens as tk
from ..operators.conversations import collect_conversations, dpo_format, format_sharegpt
from ..session import materialised
from ..sources import fixtures as fx
from ..sources.readers import literal_table, table


def chat_sequences(spark: SparkSession, d: str, test_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Logit-KD data slice: turns → ShareGPT → messages → ChatML text → exact seeded split."""
    text = format_sharegpt(collect_conversations(table(spark, d, "conversations")))
    return od.train_test_split(text, "conv_id", test_size, seed).select(
        "conv_id", "split", F.length("text").cast("long").alias("n_chars"), "text")


def chat_kd_dataset(spark: SparkSession, d: str, vocab_size: int = 4096, cfg: DistillConfig = DistillConfig(),
                    max_length: int | None = None) -> DataFrame:
    """Entry 1 end to end: ChatML text encoded with a vocabulary fitted on the corpus, truncated
    and padded to ``max_length`` (default ``cfg.max_length``; pad = eos), with attention masks
    and the seeded split of ``cfg.test_size``."""
    n = max_length or cfg.max_length
    seqs = chat_sequences(spark, d, cfg.test_size, cfg.seed)
    vocab = tk.fit_vocab(table(spark, d, "documents"), "text", vocab_size)
    eos = tk.SPECIALS.index("<eos>")
    enc = tk.encode_padded(seqs, "text", vocab, n, eos)
    return enc.select("conv_id", "split", F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).cast("long")
                      .alias("n_tokens"), "input_ids", "attention_mask")


def preference_batches(spark: SparkSession, d: str, cfg: DPOConfig = DPOConfig()) -> DataFrame:
    """Entry 2 per batch: sequence log-probs of policy (student) and reference (teacher), DPO
    loss + kd_weight · batch KD, and the logged metrics as (batch_id, metric, value)."""
    pairs = pf.pair_table(fx.pref_tokens(spark, d), kd_temperature=cfg.kd_temperature).withColumn("aux_loss", F.lit(0.0))
    return pf.composed_metrics(pf.composed_loss(pairs, cfg), cfg)


def preference_sequences(pairs: DataFrame, vocab: DataFrame, cfg: DPOConfig = DPOConfig(), pad_id: int = 1,
                         batch: Column | None = None, seed: int = SEED) -> DataFrame:
    """Entry 2 up to the model: (pair_id, system, question, chosen, rejected) → stacked token sequences with labels.

    ``cfg.val_split`` of the pairs, an exact seeded share, are for evaluation (``is_eval``); prompts and completions
    with ``cfg.suffix`` are encoded, padded within ``batch`` and split, stacked, joined, flushed left, cut to
    ``cfg.max_length`` by ``cfg.truncation_mode`` and shifted."""
    split = od.train_test_split(pairs, "pair_id", cfg.val_split, seed)
    f = dpo_format(split, keep=("pair_id", "split"), suffix=cfg.suffix)
    own = F.col("pair_id") if batch is None else batch
    e = tk.encode_columns(f, {"prompt": "prompt", "chosen": "chosen", "rejected": "rejected"}, vocab)
    e = e.withColumn("batch_id", own * 2 + (F.col("split") == "test").cast("int"))      # a batch is of one split
    rows = sq.flush_left(sq.concat_prompt_completion(sq.stack_pairs(sq.pad_pairs(e, pad_id))))
    if cfg.max_length is not None:
        rows = sq.truncate_rows(rows, cfg.max_length, cfg.truncation_mode)
    return sq.shift_labels(rows).withColumn("is_eval", F.col("batch_id") % 2 == 1)


def preference_flow(pairs: DataFrame, vocab: DataFrame, score: Callable[[DataFrame], DataFrame], cfg: DPOConfig = DPOConfig(),
                    batch: Column | None = None, use_weighting: bool = False, seed: int = SEED) -> DataFrame:
    """Entry 2 end to end, from text pairs to (batch_id, metric, value); metrics of evaluation batches are
    named ``eval_…``.

    ``score`` adds student ``logits`` and teacher ``t_logits`` to rows of (batch_id, pair_id, side, row, pos, input_id,
    label, loss_mask): a join with stored scores, or a model through ``udf.map_rows``.  Batch
    ids are twice those of ``batch``, plus one for evaluation."""
    rows = preference_sequences(pairs, vocab, cfg, tk.SPECIALS.index("<eos>"), batch, seed)
    table = pf.pair_table(score(sq.token_rows(rows)), kd_temperature=cfg.kd_temperature).withColumn("is_eval", F.col("batch_id") % 2 == 1)
    losses = pf.composed_loss(table.withColumn("aux_loss", F.lit(0.0)), cfg, use_weighting)
    return pf.composed_metrics(losses, cfg, eval_col="is_eval")


def reasoning_eval(spark: SparkSession, d: str, models: list, generate: Callable[..., list],
                   cfg: EvalConfig = EvalConfig(), n_items: int | None = None) -> tuple:
    """Entry 3: for every model and shot setting build GSM and ARC prompts (demos from a seeded
    pool), generate through the hook (``generate(prompts, model=…)``), score, and return (detail
    rows, summary, pivot)."""
    shots, seed = cfg.shots, cfg.seed
    gsm, arc = fx.gsm_items(spark, d), fx.arc_items(spark, d)
    gsm_test = od.bounded_head(gsm, ["item_id"], n_items or cfg.gsm_samples)
    arc_test = od.bounded_head(arc, ["item_id"], n_items or cfg.arc_samples)
    prompts = []
    for label, n in shots:
        g = ev.few_shot_prompt_gsm(gsm_test, ev.gsm_demo_block(gsm, n, seed, strip_q=False), n,
                                   fallback=ev.gsm_demo_block(gsm, n, seed, strip_q=True) if n else None)
        a = ev.few_shot_prompt_arc(arc_test, ev.arc_demo_block_text(arc, n, seed), n,
                                   fallback=ev.arc_demo_block(arc, n, seed) if n else None)
        prompts.append(g.select("item_id", "prompt", F.lit(GSM_NAME).alias("dataset"), F.lit(label).alias("shot")))
        prompts.append(a.select("item_id", "prompt", F.lit(ARC_NAME).alias("dataset"), F.lit(label).alias("shot")))
    allp = prompts[0]
    for p in prompts[1:]:
        allp = allp.unionByName(p)
    mdf = literal_table(spark, [(m,) for m in models], "model string")
    gens = ev.generate_batch(allp.crossJoin(F.broadcast(mdf)), generate, stops=cfg.stops,
                             max_new_tokens=cfg.max_new_tokens, model_col="model")
    # every prompt is generated once: both datasets and all tables below read what was written
    gens = materialised(gens, "generations")
    sg = ev.score_gsm(gens.where(F.col("dataset") == GSM_NAME), gsm)
    sa = ev.score_arc(gens.where(F.col("dataset") == ARC_NAME), arc)
    detail = sg.select("model", "dataset", "shot", "item_id", "correct").unionByName(
        sa.select("model", "dataset", "shot", "item_id", "correct"))
    grid = (mdf.crossJoin(literal_table(spark, [(GSM_NAME,), (ARC_NAME,)], "dataset string"))
            .crossJoin(literal_table(spark, [(s,) for s, _ in shots], "shot string")))
    summary = ev.accuracy_summary(detail, grid)
    return detail, summary, ev.accuracy_pivot(summary, [s for s, _ in shots])
