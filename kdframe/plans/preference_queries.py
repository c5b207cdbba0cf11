"""§2.6 preference losses and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SEED, DPOConfig
from ..functions.arrays import idiv
from ..operators import preference as pf
from ..operators import tokens as tk
from ..sources import fixtures as fx
from ..sources.readers import table
from . import flows
from .registry import register
from .score_queries import kl, lse, lsm
from .sequence_queries import BATCH_SQL, concat_sql, flush_sql, keep_end_sql, pt_sql, stack_sql
from .sqlparts import DPO_PAIRS, md5_key

TOK = fx.PREF_TOKENS_SQL
BETA = 0.1


def _lp_sql(col="logits", tok=TOK):
    return (f"SELECT *, CASE WHEN loss_mask = 1 THEN {col}[label + 1] - {lse(col)} ELSE 0.0 END AS lp, "
            f"CASE WHEN loss_mask = 1 THEN label ELSE 0 END AS label0 FROM ({tok})")


def _seq_sql(col="logits", ipo=False, tok=TOK):
    v = "sum(lp) / sum(loss_mask)" if ipo else "sum(lp)"
    return f"""
SELECT batch_id, pair_id, max(v) FILTER (WHERE side = 'chosen') AS chosen_logps,
       max(v) FILTER (WHERE side = 'rejected') AS rejected_logps
FROM (SELECT batch_id, pair_id, side, {v} AS v FROM ({_lp_sql(col, tok)}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def _dpo_cols_sql(c, r, rc, rr, beta=BETA):
    x = f"({beta} * (({c} - {r}) - ({rc} - {rr})))"
    return (f"CASE WHEN {x} >= 0 THEN ln(1 + exp(-{x})) ELSE -{x} + ln(1 + exp({x})) END AS loss, "
            f"{beta} * ({c} - {rc}) AS chosen_reward, {beta} * ({r} - {rr}) AS rejected_reward, "
            f"{beta} * ({c} - {rc}) - {beta} * ({r} - {rr}) AS margin")


def pair_dpo_sql(tok=TOK):
    return f"""
SELECT s.batch_id, s.pair_id, s.chosen_logps AS chosen, s.rejected_logps AS rejected,
       {_dpo_cols_sql('s.chosen_logps', 's.rejected_logps', 't.chosen_logps', 't.rejected_logps')}
FROM ({_seq_sql('logits', tok=tok)}) s JOIN ({_seq_sql('t_logits', tok=tok)}) t ON t.pair_id = s.pair_id"""


def batch_kd_sql(tok=TOK, example="example_id"):
    return f"""
SELECT batch_id, sum(kl_ex) / count(*) AS kd FROM (
  SELECT batch_id, {example}, sum({kl('logits', 't_logits', 1.0)}) AS kl_ex FROM ({tok}) GROUP BY 1, 2) GROUP BY 1"""


def mean_logits_sql(tok=TOK):
    return f"""
SELECT batch_id, max(v) FILTER (WHERE side = 'chosen') AS mean_chosen_logits,
       max(v) FILTER (WHERE side = 'rejected') AS mean_rejected_logits
FROM (SELECT batch_id, side, sum(list_sum(logits)) / sum(len(logits)) AS v FROM ({tok}) WHERE loss_mask = 1 GROUP BY 1, 2)
GROUP BY 1"""


PAIR_DPO_SQL, BATCH_KD_SQL, MEAN_LOGITS_SQL = pair_dpo_sql(), batch_kd_sql(), mean_logits_sql()


def r6(x):
    return f"round({x}, 6)"


def _r(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _tokens(spark, d):
    return fx.pref_tokens(spark, d)


@register("sequence_logps", f"""
SELECT batch_id, pair_id, {r6('chosen_logps')} AS chosen_logps, {r6('rejected_logps')} AS rejected_logps FROM ({_seq_sql()})""")
def q_sequence_logps(spark, d):
    s = pf.sequence_logps(_tokens(spark, d))
    return s.select("batch_id", "pair_id", _r("chosen_logps").alias("chosen_logps"), _r("rejected_logps").alias("rejected_logps"))


@register("ipo_average", f"""
SELECT batch_id, pair_id, {r6('chosen_logps')} AS chosen_logps, {r6('rejected_logps')} AS rejected_logps FROM ({_seq_sql(ipo=True)})""")
def q_ipo_average(spark, d):
    s = pf.sequence_logps(_tokens(spark, d), ipo=True)
    return s.select("batch_id", "pair_id", _r("chosen_logps").alias("chosen_logps"), _r("rejected_logps").alias("rejected_logps"))


@register("reference_logps", f"""
SELECT s.pair_id, {r6('s.chosen_logps')} AS chosen_logps, {r6('t.chosen_logps')} AS ref_chosen, {r6('t.rejected_logps')} AS ref_rejected
FROM ({_seq_sql('logits')}) s LEFT JOIN ({_seq_sql('t_logits')}) t ON t.pair_id = s.pair_id""")
def q_reference_logps(spark, d):
    tok = _tokens(spark, d)
    ref = pf.sequence_logps(tok, "t_logits").select("pair_id", F.col("chosen_logps").alias("ref_chosen"),
                                                    F.col("rejected_logps").alias("ref_rejected"))
    out = pf.reference_logps(pf.sequence_logps(tok, "logits"), ref)
    return out.select("pair_id", _r("chosen_logps").alias("chosen_logps"), _r("ref_chosen").alias("ref_chosen"),
                      _r("ref_rejected").alias("ref_rejected"))


@register("dpo_loss", f"""
SELECT pair_id, {r6('loss')} AS loss, {r6('chosen_reward')} AS chosen_reward, {r6('rejected_reward')} AS rejected_reward,
       {r6('margin')} AS margin
FROM (SELECT pair_id, {_dpo_cols_sql('chosen', 'rejected', 'ref_chosen', 'ref_rejected')} FROM ({fx.PAIR_LOGPS_SQL}))""")
def q_dpo_loss(spark, d):
    out = pf.dpo_loss(fx.pair_logps(spark, d), BETA)
    return out.select("pair_id", *[_r(c).alias(c) for c in ("loss", "chosen_reward", "rejected_reward", "margin")])


@register("reward_accuracy", f"""
SELECT pair_id, CAST(chosen_reward > rejected_reward AS DOUBLE) AS reward_accuracy
FROM (SELECT pair_id, {_dpo_cols_sql('chosen', 'rejected', 'ref_chosen', 'ref_rejected')} FROM ({fx.PAIR_LOGPS_SQL}))""")
def q_reward_accuracy(spark, d):
    return pf.reward_accuracy(pf.dpo_loss(fx.pair_logps(spark, d), BETA)).select("pair_id", "reward_accuracy")


@register("rpo_nll", f"""
SELECT batch_id, {r6(f"avg({lse('logits')} - logits[label0 + 1])")} AS nll_loss
FROM ({_lp_sql()}) WHERE side = 'chosen' AND label0 <> 0 GROUP BY 1""")
def q_rpo_nll(spark, d):
    return pf.rpo_nll(_tokens(spark, d)).select("batch_id", _r("nll_loss").alias("nll_loss"))


def _wpo_sql(faithful: bool):
    lp = ("coalesce(lag(lp) OVER (PARTITION BY pair_id, side ORDER BY pos), "
          "first_value(lp) OVER (PARTITION BY pair_id, side ORDER BY pos DESC))") if faithful else "lp"
    adj = lse(f"list_transform({lsm('logits')}, lambda v: v * 2.0)")
    return f"""
SELECT batch_id, pair_id, least(1.0, exp(max(w) FILTER (WHERE side = 'chosen') + max(w) FILTER (WHERE side = 'rejected'))) AS policy_weight
FROM (SELECT batch_id, pair_id, side, sum((lpx - adj) * loss_mask) / sum(loss_mask) AS w FROM (
        SELECT batch_id, pair_id, side, pos, loss_mask, {lp} AS lpx, {adj} AS adj FROM ({_lp_sql()}))
      GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@register("wpo_weights", f"""
SELECT a.pair_id, {r6('a.policy_weight')} AS policy_weight, {r6('b.policy_weight')} AS policy_weight_faithful
FROM ({_wpo_sql(False)}) a JOIN ({_wpo_sql(True)}) b ON b.pair_id = a.pair_id""")
def q_wpo_weights(spark, d):
    tok = _tokens(spark, d)
    a = pf.wpo_weights(tok)
    b = pf.wpo_weights(tok, faithful_shift=True).select("pair_id", F.col("policy_weight").alias("policy_weight_faithful"))
    return a.join(b, "pair_id").select("pair_id", _r("policy_weight").alias("policy_weight"),
                                       _r("policy_weight_faithful").alias("policy_weight_faithful"))


@register("aux_loss_mix", f"""
SELECT l.pair_id, {r6('l.loss + 0.01 * coalesce(CAST(o.o_orderkey % 5 AS DOUBLE) / 10.0, 0.0)')} AS loss
FROM (SELECT pair_id, {_dpo_cols_sql('chosen', 'rejected', 'ref_chosen', 'ref_rejected')} FROM ({fx.PAIR_LOGPS_SQL})) l
JOIN orders o ON o.o_orderkey = l.pair_id""")
def q_aux_loss_mix(spark, d):
    from ..sources.readers import table
    aux = table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"),
                                           ((F.col("o_orderkey") % 5).cast("double") / 10.0).alias("aux_loss"))
    l = pf.dpo_loss(fx.pair_logps(spark, d), BETA).join(aux, "pair_id")
    return pf.aux_loss_mix(l, 0.01).select("pair_id", _r("loss").alias("loss"))


AUX_SQL = "(p.pair_id % 5) / 10.0::DOUBLE"
NLL_SQL = f"SELECT batch_id, avg({lse('logits')} - logits[label0 + 1]) AS nll FROM ({_lp_sql()}) WHERE side = 'chosen' AND label0 <> 0 GROUP BY 1"
FULL = DPOConfig(beta=BETA, rpo_alpha=0.5, aux_loss_coef=0.01)


def _pairs(spark, d):
    return pf.pair_table(_tokens(spark, d)).withColumn("aux_loss", (F.col("pair_id") % 5) / 10.0)


@register("dpo_kd_total", f"""
SELECT p.batch_id, {r6('avg(p.loss + 0.001 * k.kd)')} AS total_loss, {r6('max(k.kd)')} AS kd,
       {r6(f'avg((p.loss + 0.5 * n.nll) * w.policy_weight + 0.01 * {AUX_SQL} + 0.001 * k.kd)')} AS total_loss_full
FROM ({PAIR_DPO_SQL}) p LEFT JOIN ({BATCH_KD_SQL}) k ON k.batch_id = p.batch_id LEFT JOIN ({NLL_SQL}) n ON n.batch_id = p.batch_id
JOIN ({_wpo_sql(False)}) w ON w.pair_id = p.pair_id GROUP BY 1""")
def q_dpo_kd_total(spark, d):
    pairs = _pairs(spark, d)
    plain = pf.composed_loss(pairs, DPOConfig(beta=BETA))
    both = pf.composed_loss(plain.withColumnRenamed("loss", "plain"), FULL, use_weighting=True)
    out = both.groupBy("batch_id").agg(F.avg("plain").alias("total_loss"), F.max("kd").alias("kd"), F.avg("loss").alias("total_loss_full"))
    return out.select("batch_id", *[_r(c).alias(c) for c in ("total_loss", "kd", "total_loss_full")])


@register("preference_metrics", f"""
WITH p AS ({PAIR_DPO_SQL}),
m AS (SELECT batch_id, avg(chosen_reward) AS a1, avg(rejected_reward) AS a2,
             avg(CAST(chosen_reward > rejected_reward AS DOUBLE)) AS a3, avg(margin) AS a4, avg(chosen) AS a5,
             avg(rejected) AS a6, avg({AUX_SQL}) AS a7 FROM p GROUP BY 1),
f AS (SELECT p.batch_id, avg((p.loss + 0.5 * n.nll) * w.policy_weight + 0.01 * {AUX_SQL} + 0.001 * k.kd) AS total, max(n.nll) AS nll
      FROM p LEFT JOIN ({BATCH_KD_SQL}) k ON k.batch_id = p.batch_id LEFT JOIN ({NLL_SQL}) n ON n.batch_id = p.batch_id
      JOIN ({_wpo_sql(False)}) w ON w.pair_id = p.pair_id GROUP BY 1),
b AS (SELECT l.batch_id, l.mean_chosen_logits, l.mean_rejected_logits, k.kd
      FROM ({MEAN_LOGITS_SQL}) l JOIN ({BATCH_KD_SQL}) k ON k.batch_id = l.batch_id)
SELECT batch_id, x.metric, round(x.value, 6) AS value FROM (
  SELECT m.batch_id, unnest([{{'metric': 'rewards/chosen', 'value': a1}}, {{'metric': 'rewards/rejected', 'value': a2}},
    {{'metric': 'rewards/accuracies', 'value': a3}}, {{'metric': 'rewards/margins', 'value': a4}},
    {{'metric': 'logps/chosen', 'value': a5}}, {{'metric': 'logps/rejected', 'value': a6}},
    {{'metric': 'logits/chosen', 'value': b.mean_chosen_logits}}, {{'metric': 'logits/rejected', 'value': b.mean_rejected_logits}},
    {{'metric': 'logits/kd', 'value': b.kd}}, {{'metric': 'loss', 'value': f.total}}, {{'metric': 'nll_loss', 'value': f.nll}},
    {{'metric': 'aux_loss', 'value': m.a7}}]) AS x
  FROM m LEFT JOIN b ON b.batch_id = m.batch_id LEFT JOIN f ON f.batch_id = m.batch_id)""")
def q_preference_metrics(spark, d):
    m = pf.composed_metrics(pf.composed_loss(_pairs(spark, d), FULL, use_weighting=True), FULL)
    return m.select("batch_id", "metric", _r("value").alias("value"))


@register("mean_masked_logits", f"""
SELECT batch_id, {r6('mean_chosen_logits')} AS mean_chosen_logits, {r6('mean_rejected_logits')} AS mean_rejected_logits
FROM ({MEAN_LOGITS_SQL})""")
def q_mean_masked_logits(spark, d):
    m = pf.mean_masked_logits(_tokens(spark, d))
    return m.select("batch_id", _r("mean_chosen_logits").alias("mean_chosen_logits"),
                    _r("mean_rejected_logits").alias("mean_rejected_logits"))


FLOW_IDS, FLOW_LENGTH = 64, 48       # size of the vocabulary, tokens kept of a sequence
FLOW = DPOConfig(max_length=FLOW_LENGTH, val_split=0.05)
FLOW_SPLIT = f"""
SELECT *, row_number() OVER (ORDER BY {md5_key(SEED, 'pair_id')}, pair_id) - 1 < (SELECT ceil(0.05 * count(*)) FROM ({DPO_PAIRS})) AS is_test
FROM ({DPO_PAIRS})"""
FLOW_ROWS = flush_sql(concat_sql(stack_sql(pt_sql(FLOW_SPLIT, FLOW_IDS, f"({BATCH_SQL}) * 2 + CAST(f.is_test AS INTEGER)"))))
FLOW_TOK = f"""
SELECT batch_id, pair_id, side, row, unnest(range(len(ids))) AS pos, unnest(ids) AS input_id,
       unnest(list_concat(ids[2:], ids[1:1])) AS label, unnest(list_concat(lm[2:], lm[1:1])) AS loss_mask
FROM (SELECT batch_id, pair_id, side, row, {keep_end_sql('input_ids', FLOW_LENGTH)} AS ids, {keep_end_sql('loss_mask', FLOW_LENGTH)} AS lm FROM ({FLOW_ROWS}))"""
FLOW_METRICS = {"rewards/chosen": "m.a1", "rewards/rejected": "m.a2", "rewards/accuracies": "m.a3", "rewards/margins": "m.a4", "logps/chosen": "m.a5",
                "logps/rejected": "m.a6", "logits/chosen": "l.mean_chosen_logits", "logits/rejected": "l.mean_rejected_logits", "logits/kd": "k.kd",
                "loss": "m.a7 + 0.001 * k.kd"}


@register("preference_flow", f"""
WITH tok AS MATERIALIZED ({fx.id_scores_sql(FLOW_TOK, FLOW_IDS)}),
m AS (SELECT batch_id, avg(chosen_reward) AS a1, avg(rejected_reward) AS a2, avg(CAST(chosen_reward > rejected_reward AS DOUBLE)) AS a3,
             avg(margin) AS a4, avg(chosen) AS a5, avg(rejected) AS a6, avg(loss) AS a7 FROM ({pair_dpo_sql('SELECT * FROM tok')}) GROUP BY 1)
SELECT batch_id, CASE WHEN batch_id % 2 = 1 THEN 'eval_' ELSE '' END || x.metric AS metric, round(x.value, 6) AS value FROM (
  SELECT m.batch_id, unnest([{', '.join(f"{{'metric': '{n}', 'value': {v}}}" for n, v in FLOW_METRICS.items())}]) AS x
  FROM m JOIN ({batch_kd_sql('SELECT * FROM tok', 'row')}) k ON k.batch_id = m.batch_id
  LEFT JOIN ({mean_logits_sql('SELECT * FROM tok')}) l ON l.batch_id = m.batch_id)""")
def q_preference_flow(spark, d):
    """Text pairs to metrics: split, format, encode, pad, stack, join, flush, truncate, shift, log-probs, loss."""
    vocab = tk.fit_vocab(table(spark, d, "documents"), "text", FLOW_IDS)
    batch = idiv("pair_id", fx.CONVS_PER_BATCH * fx.PAIR_STRIDE)
    m = flows.preference_flow(fx.dpo_pairs(spark, d), vocab, lambda t: fx.id_scores(t, FLOW_IDS), FLOW, batch)
    return m.select("batch_id", "metric", _r("value").alias("value"))
