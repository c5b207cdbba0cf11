"""Preference (DPO) losses and metrics over per-token scores and per-sequence log-probs.

Token rows: (batch_id, pair_id, side, pos, logits ARRAY<DOUBLE>, label, loss_mask).  Sequence
sums are hash aggregates on (pair_id, side) followed by a pivot on the two known side values;
every group is one sequence or one batch.  DPO formula (Rafailov et al. 2023):
loss = −log σ(β[(π_c − π_r) − (ref_c − ref_r)]), rewards = β(π − ref).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DPOConfig
from ..functions import scores as sc
from ..functions.arrays import roll_right

SIDES = ["chosen", "rejected"]


def token_logps(tokens: DataFrame, logits: str = "logits") -> DataFrame:
    """Masked labels → token 0, per-token log-prob, masked log-probs → 0."""
    lab = F.when(F.col("loss_mask") == 1, F.col("label")).otherwise(F.lit(0))
    return (tokens.withColumn("label0", lab)
            .withColumn("lp", F.when(F.col("loss_mask") == 1, sc.selective_log_softmax(logits, lab)).otherwise(F.lit(0.0))))


def sequence_logps(tokens: DataFrame, logits: str = "logits", ipo: bool = False,
                   keys=("batch_id", "pair_id")) -> DataFrame:
    """(keys…, chosen_logps, rejected_logps): Σ masked token log-probs per sequence (the +1 roll
    of the source does not change a sum); ``ipo`` divides by the number of loss tokens."""
    t = token_logps(tokens, logits)
    # a sequence without loss tokens has no IPO average (0/0): null instead of an ANSI error
    val = F.try_divide(F.sum("lp"), F.sum("loss_mask")) if ipo else F.sum("lp")
    per = t.groupBy(*keys, "side").agg(val.alias("v"))
    return per.groupBy(*keys).pivot("side", SIDES).agg(F.first("v")).select(
        *keys, F.col("chosen").alias("chosen_logps"), F.col("rejected").alias("rejected_logps"))


def reference_logps(df: DataFrame, ref: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """Use precomputed ``ref_chosen``/``ref_rejected`` if both columns exist, else join them in."""
    if "ref_chosen" in df.columns and "ref_rejected" in df.columns:
        return df
    if ref is None:
        raise ValueError("no reference log-probs: pass a reference table")
    return df.join(ref.select(key, "ref_chosen", "ref_rejected"), key, "left")


def softplus_neg(x: Column) -> Column:
    """−log σ(x) = log(1 + e^{−x}), evaluated stably on both signs."""
    return F.when(x >= 0, F.log1p(F.exp(-x))).otherwise(-x + F.log1p(F.exp(x)))


def dpo_loss(df: DataFrame, beta: float = 0.1, chosen="chosen", rejected="rejected",
             ref_chosen="ref_chosen", ref_rejected="ref_rejected") -> DataFrame:
    """Per pair: loss, chosen_reward, rejected_reward, margin."""
    x = beta * ((F.col(chosen) - F.col(rejected)) - (F.col(ref_chosen) - F.col(ref_rejected)))
    return (df.withColumn("loss", softplus_neg(x))
            .withColumn("chosen_reward", beta * (F.col(chosen) - F.col(ref_chosen)))
            .withColumn("rejected_reward", beta * (F.col(rejected) - F.col(ref_rejected)))
            .withColumn("margin", F.col("chosen_reward") - F.col("rejected_reward")))


def reward_accuracy(df: DataFrame) -> DataFrame:
    """1.0 iff the chosen reward is strictly greater."""
    return df.withColumn("reward_accuracy", (F.col("chosen_reward") > F.col("rejected_reward")).cast("double"))


def rpo_nll(tokens: DataFrame, logits: str = "logits", batch_col: str = "batch_id") -> DataFrame:
    """Mean CE over chosen rows with ignore_index = 0: masked labels were set to 0, so a real
    token 0 is ignored as well (kept as in the source)."""
    t = token_logps(tokens, logits).where((F.col("side") == "chosen") & (F.col("label0") != 0))
    return t.groupBy(batch_col).agg(F.avg(-sc.selective_log_softmax(logits, "label0")).alias("nll_loss"))


def wpo_weights(tokens: DataFrame, logits: str = "logits", faithful_shift: bool = False,
                keys=("batch_id", "pair_id")) -> DataFrame:
    """Per pair: min(1, exp(w_c + w_r)), w = mean over loss tokens of (logp − log Σ p²).

    The source multiplies log-probs rolled by +1 with the un-rolled mask; ``faithful_shift``
    reproduces that, the default keeps them aligned.
    """
    t = token_logps(tokens, logits).withColumn("_adj", sc.wpo_adjust(logits))
    seq = t.groupBy(*keys, "side").agg(F.array_sort(F.collect_list(F.struct("pos", "lp", "_adj", "loss_mask"))).alias("_s"))
    lp = F.transform("_s", lambda x: x["lp"])
    if faithful_shift:
        lp = roll_right(lp)
    adj = F.zip_with(lp, F.transform("_s", lambda x: x["_adj"]), lambda a, b: a - b)
    num = sc.array_sum(F.zip_with(adj, F.transform("_s", lambda x: x["loss_mask"].cast("double")), lambda a, m: a * m))
    den = F.aggregate(F.transform("_s", lambda x: x["loss_mask"]), F.lit(0), lambda a, m: a + m)
    w = seq.select(*keys, "side", F.try_divide(num, den).alias("w"))
    p = w.groupBy(*keys).pivot("side", SIDES).agg(F.first("w"))
    return p.select(*keys, F.least(F.lit(1.0), F.exp(F.col("chosen") + F.col("rejected"))).alias("policy_weight"))


def pair_table(tokens: DataFrame, logits: str = "logits", ref_logits: str = "t_logits", keys=("batch_id", "pair_id"),
               kd_temperature: float = 1.0) -> DataFrame:
    """Everything the preference loss and its metrics need, one narrow row a pair, from one pass over
    the scores: each row's logit arrays are read where they lie and only sums are shuffled.

    Per side: log-prob sums of policy and reference, loss tokens, summed WPO adjustment, sum and
    number of logit values at loss positions; per pair: KL sum over all positions, rows, and the
    summed CE and count of the chosen side's non-zero labels.
    """
    on = F.col("loss_mask") == 1
    lp = F.when(on, sc.selective_log_softmax(logits, "label")).otherwise(0.0)
    ref = F.when(on, sc.selective_log_softmax(ref_logits, "label")).otherwise(0.0)
    t = tokens.select(*keys, "side", "loss_mask", "label", lp.alias("lp"), ref.alias("ref"),
                      sc.kl_row(logits, ref_logits, kd_temperature).alias("kl"),
                      F.when(on, sc.wpo_adjust(logits)).otherwise(0.0).alias("adj"),
                      F.when(on, sc.array_sum(logits)).otherwise(0.0).alias("total"), F.when(on, F.size(logits)).otherwise(0).alias("size"))

    def of(side: str, value) -> Column:
        return F.sum(F.when(F.col("side") == side, value))

    sides = [x for s in SIDES for x in (
        of(s, F.col("lp")).alias(s), of(s, F.col("ref")).alias(f"ref_{s}"), of(s, F.col("loss_mask")).alias(f"n_{s}"),
        of(s, F.col("lp") - F.col("adj")).alias(f"w_{s}"), of(s, F.col("total")).alias(f"logits_{s}"), of(s, F.col("size")).alias(f"size_{s}"))]
    counted = (F.col("side") == "chosen") & (F.col("loss_mask") == 1) & (F.col("label") != 0)
    rows = sum(F.max(F.when(F.col("side") == s, 1).otherwise(0)) for s in SIDES[1:]) + F.max(F.when(F.col("side") == SIDES[0], 1).otherwise(0))
    return t.groupBy(*keys).agg(*sides, F.sum("kl").alias("kl"), rows.alias("rows"),
                                F.sum(F.when(counted, -F.col("lp"))).alias("nll_sum"), F.count(F.when(counted, 1)).alias("nll_n"))


def composed_loss(pairs: DataFrame, cfg: DPOConfig = DPOConfig(), use_weighting: bool = False, ipo: bool = False,
                  batch_col: str = "batch_id") -> DataFrame:
    """Per-pair loss of ``pair_table`` rows in the order of the source: DPO, + ``rpo_alpha`` · batch NLL of
    the chosen side, × WPO weight, + ``aux_loss_coef`` · ``aux_loss`` (a column of ``pairs``, if the
    coefficient is set), + ``kd_weight`` · batch KD.  ``ipo`` averages log-probs over loss tokens.
    Adds loss, rewards, margin, reward_accuracy, kd, nll_loss and policy_weight."""
    w = Window.partitionBy(batch_col)
    out = (pairs.withColumn("kd", F.sum("kl").over(w) / F.sum("rows").over(w) * cfg.kd_temperature ** 2)
           .withColumn("nll_loss", F.try_divide(F.sum("nll_sum").over(w), F.sum("nll_n").over(w)))
           .withColumn("policy_weight", F.least(F.lit(1.0), F.exp(F.try_divide(F.col("w_chosen"), F.col("n_chosen"))
                                                                  + F.try_divide(F.col("w_rejected"), F.col("n_rejected"))))))
    if ipo:
        for s in SIDES:
            out = out.withColumn(s, F.try_divide(F.col(s), F.col(f"n_{s}"))).withColumn(f"ref_{s}", F.try_divide(F.col(f"ref_{s}"), F.col(f"n_{s}")))
    out = reward_accuracy(dpo_loss(out, cfg.beta))
    loss = F.col("loss")
    if cfg.rpo_alpha is not None:
        loss = loss + cfg.rpo_alpha * F.col("nll_loss")
    if use_weighting:
        loss = loss * F.col("policy_weight")
    if cfg.aux_loss_coef:
        loss = loss + cfg.aux_loss_coef * F.coalesce("aux_loss", F.lit(0.0))
    return out.withColumn("loss", loss + cfg.kd_weight * F.col("kd"))


def composed_metrics(losses: DataFrame, cfg: DPOConfig = DPOConfig(), batch_col: str = "batch_id", train_eval: str = "train",
                     eval_col: str | None = None) -> DataFrame:
    """(batch_id, metric, value) of ``composed_loss`` rows, one aggregate: the logged means, the total
    ``loss``, and ``nll_loss`` / ``aux_loss`` where their options are on.  Names begin with ``eval_`` for
    ``train_eval='eval'``, or batch by batch where the boolean ``eval_col`` is true."""
    mean = lambda c: F.avg(c)
    values = {"rewards/chosen": mean("chosen_reward"), "rewards/rejected": mean("rejected_reward"),
              "rewards/accuracies": mean("reward_accuracy"), "rewards/margins": mean("margin"),
              "logps/chosen": mean("chosen"), "logps/rejected": mean("rejected"),
              "logits/chosen": F.try_divide(F.sum("logits_chosen"), F.sum("size_chosen")),
              "logits/rejected": F.try_divide(F.sum("logits_rejected"), F.sum("size_rejected")),
              "logits/kd": F.max("kd"), "loss": mean("loss")}
    if cfg.rpo_alpha is not None:
        values["nll_loss"] = F.max("nll_loss")
    if cfg.aux_loss_coef:
        values["aux_loss"] = mean("aux_loss")
    evaluated = F.lit(train_eval == "eval") if eval_col is None else F.max(eval_col)
    row = losses.groupBy(batch_col).agg(evaluated.alias("_e"), *[v.cast("double").alias(f"_m{i}") for i, v in enumerate(values.values())])
    name = lambda m: F.when(F.col("_e"), F.lit(f"eval_{m}")).otherwise(F.lit(m))
    pairs = F.array(*[F.struct(name(m).alias("metric"), F.col(f"_m{i}").alias("value")) for i, m in enumerate(values)])
    return row.select(batch_col, F.inline(pairs))


def aux_loss_mix(df: DataFrame, coef: float, loss: str = "loss", aux: str = "aux_loss") -> DataFrame:
    return df.withColumn(loss, F.col(loss) + coef * F.coalesce(F.col(aux), F.lit(0.0)))


def mean_masked_logits(tokens: DataFrame, logits: str = "logits", batch_col: str = "batch_id") -> DataFrame:
    """(batch_id, chosen_mean_logits, rejected_mean_logits): mean of every logit value at loss positions."""
    t = tokens.where(F.col("loss_mask") == 1).select(batch_col, "side", sc.array_sum(logits).alias("_s"),
                                                      F.size(logits).alias("_n"))
    per = t.groupBy(batch_col, "side").agg((F.sum("_s") / F.sum("_n")).alias("v"))
    p = per.groupBy(batch_col).pivot("side", SIDES).agg(F.first("v"))
    return p.select(batch_col, F.col("chosen").alias("mean_chosen_logits"), F.col("rejected").alias("mean_rejected_logits"))


METRICS = ["rewards/chosen", "rewards/rejected", "rewards/accuracies", "rewards/margins", "logps/chosen",
           "logps/rejected", "logits/chosen", "logits/rejected", "logits/kd"]


def preference_metrics(per_pair: DataFrame, per_batch: DataFrame, batch_col: str = "batch_id",
                       train_eval: str = "train") -> DataFrame:
    """(batch_id, metric, value) — batch means of the logged quantities, ``eval_`` prefix for eval."""
    means = per_pair.groupBy(batch_col).agg(
        F.avg("chosen_reward").alias("rewards/chosen"), F.avg("rejected_reward").alias("rewards/rejected"),
        F.avg("reward_accuracy").alias("rewards/accuracies"), F.avg("margin").alias("rewards/margins"),
        F.avg("chosen").alias("logps/chosen"), F.avg("rejected").alias("logps/rejected"))
    j = means.join(per_batch.select(batch_col, F.col("mean_chosen_logits").alias("logits/chosen"),
                                    F.col("mean_rejected_logits").alias("logits/rejected"),
                                    F.col("kd").alias("logits/kd")), batch_col, "left")
    prefix = "eval_" if train_eval == "eval" else ""
    cols = [F.col(f"`{m}`") for m in METRICS]
    stacked = j.select(batch_col, F.explode(F.array(*[F.struct(F.lit(prefix + m).alias("metric"), c.cast("double").alias("value"))
                                                       for m, c in zip(METRICS, cols)])).alias("_m"))
    return stacked.select(batch_col, "_m.metric", "_m.value")
