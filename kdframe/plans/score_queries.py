"""§2.4 alignment, vocab policies, softmax / KL, the KD loss variants, hidden-state KD."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions.arrays import idiv
from ..operators import distill as ds
from ..operators import hidden as hd
from ..sources import fixtures as fx
from ..session import ensure_checkpoint_dir
from ..sources.readers import table
from .registry import register

BATCH = fx.EXAMPLES_PER_BATCH
CUT = fx.STUDENT_VOCAB_CUT
PAIRS = fx.logits_pair_sql(None)
PAIRS60 = fx.logits_pair_sql(CUT)


def lse(x, T=1.0):
    return f"(list_max({x})/{T} + ln(list_sum(list_transform({x}, lambda v: exp((v - list_max({x}))/{T})))))"


def lsm(x, T=1.0):
    return f"list_transform({x}, lambda v: v/{T} - {lse(x, T)})"


def kl(s, t, T=1.0):
    return f"list_sum(list_transform(list_zip({lsm(t, T)}, {lsm(s, T)}), lambda z: exp(z[1]) * (z[1] - z[2])))"


def zpad(a, b):
    return f"list_concat({a}, list_transform(range(greatest(len({b}) - len({a}), 0)), lambda x: 0.0::DOUBLE))"


def r6(x):
    return f"round({x}, 6)"


PADDED = f"SELECT example_id, pos, {zpad('s', 't')} AS s, {zpad('t', 's')} AS t FROM ({PAIRS60})"
TRUNC = f"SELECT example_id, pos, s[1:least(len(s), len(t))] AS s, t[1:least(len(s), len(t))] AS t FROM ({PAIRS60})"


def kd_sql(src, T, scale=1.0, batch=BATCH):
    return f"""
SELECT batch_id, sum(kl_ex) / count(*) * {T * T} * {scale} AS kd FROM (
  SELECT example_id // {batch} AS batch_id, example_id, sum(kl) AS kl_ex
  FROM (SELECT example_id, {kl('s', 't', T)} AS kl FROM ({src})) GROUP BY 1, 2) GROUP BY batch_id"""


def ce_sql(pairs):
    return f"""
SELECT p.example_id // {BATCH} AS batch_id, avg({lse('p.s')} - p.s[l.label + 1]) AS ce
FROM ({pairs}) p JOIN ({fx.LABELS_SQL}) l ON l.example_id = p.example_id AND l.pos = p.pos + 1
WHERE l.label <> -100 GROUP BY 1"""


CE60_SQL, CE_SQL = ce_sql(PAIRS60), ce_sql(PAIRS)


def _pairs(spark, d, cut=None):
    return fx.logits_pair(spark, d, cut).withColumn("batch_id", idiv("example_id", BATCH))


def _ce(spark, d, cut=None):
    s = fx.student_logits(spark, d, cut).withColumn("batch_id", idiv("example_id", BATCH))
    return ds.hard_ce(s, fx.labels_tok(spark, d))


def _r(c):
    return F.round(c, 6)


@register("align_scores", f"""
SELECT example_id, pos, {r6('list_sum(s)')} AS s_sum, {r6('list_sum(t)')} AS t_sum FROM ({PAIRS})""")
def q_align_scores(spark, d):
    a = ds.align_scores(fx.student_logits(spark, d), fx.teacher_logits(spark, d))
    return a.select("example_id", "pos", _r(sc.array_sum("s")).alias("s_sum"), _r(sc.array_sum("t")).alias("t_sum"))


@register("pad_vocab", f"""
SELECT example_id, pos, CAST(len(s) AS BIGINT) AS n_vocab, {r6(kl('s', 't', 2.0))} AS kl FROM ({PADDED})""")
def q_pad_vocab(spark, d):
    p = ds.with_vocab_policy(_pairs(spark, d, CUT), "pad")
    return p.select("example_id", "pos", F.size("s").cast("long").alias("n_vocab"), _r(sc.kl_row("s", "t", 2.0)).alias("kl"))


@register("truncate_vocab", f"""
SELECT example_id, pos, CAST(len(s) AS BIGINT) AS n_vocab, {r6(kl('s', 't', 1.0))} AS kl FROM ({TRUNC})""")
def q_truncate_vocab(spark, d):
    p = ds.with_vocab_policy(_pairs(spark, d, CUT), "truncate")
    return p.select("example_id", "pos", F.size("s").cast("long").alias("n_vocab"), _r(sc.kl_row("s", "t", 1.0)).alias("kl"))


@register("softmax_t", f"""
SELECT example_id, pos, {r6(f"list_max({lsm('logits', 2.0)})")} AS lp_max, {r6(f"list_sum(list_transform({lsm('logits', 2.0)}, lambda v: exp(v)))")} AS p_sum,
       {r6(f"exp(({lsm('logits', 2.0)})[1])")} AS p_first
FROM ({fx.TEACHER_LOGITS_SQL})""")
def q_softmax_t(spark, d):
    t = fx.teacher_logits(spark, d)
    p = sc.softmax_t("logits", 2.0)
    return t.select("example_id", "pos", _r(F.array_max(sc.log_softmax_t("logits", 2.0))).alias("lp_max"),
                    _r(sc.array_sum(p)).alias("p_sum"), _r(F.element_at(p, 1)).alias("p_first"))


@register("log_softmax_t", f"""
SELECT example_id, pos, {r6(f"({lsm('logits', 2.0)})[1]")} AS lp_first, {r6(f"list_min({lsm('logits', 2.0)})")} AS lp_min
FROM ({fx.TEACHER_LOGITS_SQL})""")
def q_log_softmax_t(spark, d):
    t = fx.teacher_logits(spark, d)
    lp = sc.log_softmax_t("logits", 2.0)
    return t.select("example_id", "pos", _r(F.element_at(lp, 1)).alias("lp_first"), _r(F.array_min(lp)).alias("lp_min"))


@register("kl_row", f"SELECT example_id, pos, {r6(kl('s', 't', 2.0))} AS kl FROM ({PAIRS})")
def q_kl_row(spark, d):
    return _pairs(spark, d).select("example_id", "pos", _r(sc.kl_row("s", "t", 2.0)).alias("kl"))


KD_LOGITS_SQL = f"""
SELECT k.batch_id, {r6('k.kd')} AS kd, {r6('c.ce')} AS ce, {r6('0.5 * k.kd + 0.5 * c.ce')} AS loss
FROM ({kd_sql(PADDED, 2.0, 1.0 / 4096)}) k LEFT JOIN ({CE60_SQL}) c ON c.batch_id = k.batch_id"""


@register("kd_loss_logits", KD_LOGITS_SQL)
def q_kd_loss_logits(spark, d):
    out = ds.kd_loss_logits(_pairs(spark, d, CUT), None, 2.0, 0.5, 4096, following=ds.next_labels(fx.labels_tok(spark, d)))
    return out.select("batch_id", _r("kd").alias("kd"), _r("ce").alias("ce"), _r("loss").alias("loss"))


@register("kd_loss_stored", KD_LOGITS_SQL)
def q_kd_loss_stored(spark, d):
    """Scores and labels stored bucketed by (example, position) and read back: the losses join them as they lie."""
    name = f"scores_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s, t, following = ds.store_scores(fx.student_logits(spark, d, CUT), fx.teacher_logits(spark, d), fx.labels_tok(spark, d), name, buckets,
                                      f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    pairs = ds.align_scores(s, t).withColumn("batch_id", idiv("example_id", BATCH))
    out = ds.kd_loss_logits(pairs, None, 2.0, 0.5, 4096, following=following)
    return out.select("batch_id", _r("kd").alias("kd"), _r("ce").alias("ce"), _r("loss").alias("loss"))


@register("kd_loss_plain", f"""
SELECT k.batch_id, {r6('k.kd')} AS kd, {r6('0.5 * k.kd + 0.5 * c.ce')} AS loss, {r6('0.5 * k.kd')} AS loss_no_ce
FROM ({kd_sql(PADDED, 2.0)}) k LEFT JOIN ({CE60_SQL}) c ON c.batch_id = k.batch_id""")
def q_kd_loss_plain(spark, d):
    out = ds.kd_loss_plain(_pairs(spark, d, CUT), None, 2.0, 0.5, following=ds.next_labels(fx.labels_tok(spark, d)))
    return out.select("batch_id", _r("kd").alias("kd"), _r("loss").alias("loss"), _r(0.5 * F.col("kd")).alias("loss_no_ce"))


@register("kd_loss_dpo", f"SELECT batch_id, {r6('kd')} AS kd FROM ({kd_sql(PAIRS, 1.0, 1.0, 4)})")
def q_kd_loss_dpo(spark, d):
    p = fx.logits_pair(spark, d).withColumn("batch_id", idiv("example_id", 4))
    return ds.kd_loss_dpo(p, 1.0).select("batch_id", _r("kd").alias("kd"))


@register("kd_loss_debug", f"SELECT batch_id, {r6('kd')} AS kd FROM ({kd_sql(TRUNC, 1.0)})")
def q_kd_loss_debug(spark, d):
    return ds.kd_loss_debug(_pairs(spark, d, CUT)).select("batch_id", _r("kd").alias("kd"))


@register("response_kd_mse", f"""
SELECT pair_id // 4 AS batch_id, {r6('avg(pow(chosen - ref_chosen, 2))')} AS mse FROM ({fx.PAIR_LOGPS_SQL}) GROUP BY 1""")
def q_response_kd_mse(spark, d):
    p = fx.pair_logps(spark, d).select(idiv("pair_id", 4).alias("batch_id"),
                                       F.col("chosen").alias("student_chosen"), F.col("ref_chosen").alias("teacher_chosen"))
    return ds.response_kd_mse(p).select("batch_id", _r("mse").alias("mse"))


@register("hard_ce", f"SELECT batch_id, {r6('ce')} AS ce FROM ({CE_SQL})")
def q_hard_ce(spark, d):
    return _ce(spark, d).select("batch_id", _r("ce").alias("ce"))


@register("layer_map", f"""
SELECT CAST(i AS INTEGER) AS student_layer,
       CAST(round_even(i * (t.n - 1) / (s.n - 1), 0) AS INTEGER) AS teacher_layer
FROM (SELECT count(DISTINCT lang) AS n FROM documents) s, (SELECT count(DISTINCT source) AS n FROM documents) t,
     LATERAL (SELECT unnest(range(s.n)) AS i)""")
def q_layer_map(spark, d):
    """Layer counts come from the tables: the languages stand for student layers, the sources for teacher layers."""
    docs = table(spark, d, "documents")
    return hd.layer_map(spark, student=docs.select(F.col("lang").alias("layer")), teacher=docs.select(F.col("source").alias("layer")))


PROJ_SQL = f"""
SELECT h.example_id, h.pos, h.layer, p.out_idx,
       list_sum(list_transform(list_zip(p.w, h.h), lambda z: z[1] * z[2])) + p.b AS v
FROM ({fx.hidden_sql('student')}) h JOIN ({fx.PROJECTIONS_SQL}) p ON p.layer = h.layer"""


PROJ_OUT_SQL = f"SELECT example_id, pos, layer, CAST(out_idx AS INTEGER) AS out_idx, {r6('v')} AS v FROM ({PROJ_SQL})"


@register("project_hidden", PROJ_OUT_SQL)
def q_project_hidden(spark, d):
    p = hd.project_hidden(fx.hidden_states(spark, d, "student"), fx.projections(spark))
    return p.select("example_id", "pos", "layer", F.posexplode("h").alias("out_idx", "v")).select(
        "example_id", "pos", "layer", F.col("out_idx").cast("int").alias("out_idx"), _r("v").alias("v"))


@register("project_hidden_tiled", PROJ_OUT_SQL)
def q_project_hidden_tiled(spark, d):
    """Tiles of 3 outputs and 5 inputs, so that neither divides its dimension."""
    p = hd.project_hidden_tiled(fx.hidden_states(spark, d, "student"), fx.projections(spark), tile=(3, 5), states=1000)
    return p.select("example_id", "pos", "layer", F.posexplode("h").alias("out_idx", "v")).select(
        "example_id", "pos", "layer", F.col("out_idx").cast("int").alias("out_idx"), _r("v").alias("v"))


HIDDEN_KD_SQL = f"""
SELECT batch_id, avg(lk) / max(dim) AS kd FROM (
  SELECT batch_id, student_layer, sum(kl_ex) / count(*) * 4.0 AS lk, max(dim) AS dim FROM (
    SELECT s.example_id // {BATCH} AS batch_id, s.student_layer, s.example_id, sum({kl('s.v', 't.h', 2.0)}) AS kl_ex,
           max(len(s.v)) AS dim
    FROM (SELECT example_id, pos, layer AS student_layer, list(v ORDER BY out_idx) AS v FROM ({PROJ_SQL}) GROUP BY 1, 2, 3) s
    JOIN (SELECT CAST(i AS INTEGER) AS sl, CAST(round_even(i * {fx.TEACHER_LAYERS - 1} / {fx.STUDENT_LAYERS - 1}, 0) AS INTEGER) AS tl FROM range({fx.STUDENT_LAYERS}) r(i)) m ON m.sl = s.student_layer
    JOIN ({fx.hidden_sql('teacher')}) t ON t.example_id = s.example_id AND t.pos = s.pos AND t.layer = m.tl
    GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY batch_id"""


@register("hidden_kd_loss", f"""
SELECT k.batch_id, {r6('k.kd')} AS kd, {r6('c.ce')} AS ce, {r6('0.5 * k.kd + 0.5 * c.ce')} AS loss
FROM ({HIDDEN_KD_SQL}) k LEFT JOIN ({CE_SQL}) c ON c.batch_id = k.batch_id""")
def q_hidden_kd_loss(spark, d):
    bid = idiv("example_id", BATCH)
    s = fx.hidden_states(spark, d, "student").withColumn("batch_id", bid)
    t = fx.hidden_states(spark, d, "teacher")
    out = hd.hidden_kd_loss(s, t, fx.projections(spark), 2.0, 0.5, ce=_ce(spark, d), num_student=fx.STUDENT_LAYERS,
                            num_teacher=fx.TEACHER_LAYERS)
    return out.select("batch_id", _r("kd").alias("kd"), _r("ce").alias("ce"), _r("loss").alias("loss"))


# Long-form variants (one row per vocabulary entry) of the same operators.

from ..operators import long_scores as lg  # noqa: E402

S_LONG = f"""
SELECT example_id, pos, CAST(vocab_id AS INTEGER) AS vocab_id, s FROM (
  SELECT example_id, pos, unnest(range(len(s))) AS vocab_id, unnest(s) AS s FROM ({PAIRS60}))"""
T_LONG = f"""
SELECT example_id, pos, CAST(vocab_id AS INTEGER) AS vocab_id, t FROM (
  SELECT example_id, pos, unnest(range(len(t))) AS vocab_id, unnest(t) AS t FROM ({PAIRS60}))"""


def _long_sides(spark, d):
    p = fx.logits_pair(spark, d, CUT)
    return lg.to_long(p, "s", "s"), lg.to_long(p, "t", "t")


def kl_long_sql(src, T):
    return f"""
WITH p AS ({src}), m AS (SELECT example_id, pos, max(t) AS mt, max(s) AS ms FROM p GROUP BY 1, 2)
SELECT p.example_id, p.pos,
       sum(exp((p.t - m.mt) / {T}) * (p.t - p.s) / {T}) / sum(exp((p.t - m.mt) / {T}))
       - (max(m.mt) / {T} + ln(sum(exp((p.t - m.mt) / {T})))) + (max(m.ms) / {T} + ln(sum(exp((p.s - m.ms) / {T})))) AS kl
FROM p JOIN m ON m.example_id = p.example_id AND m.pos = p.pos GROUP BY 1, 2"""


PAD_LONG_SQL = f"""
SELECT coalesce(s.example_id, t.example_id) AS example_id, coalesce(s.pos, t.pos) AS pos,
       coalesce(s.vocab_id, t.vocab_id) AS vocab_id, coalesce(s.s, 0.0) AS s, coalesce(t.t, 0.0) AS t
FROM ({S_LONG}) s FULL OUTER JOIN ({T_LONG}) t ON s.example_id = t.example_id AND s.pos = t.pos AND s.vocab_id = t.vocab_id"""

TRUNC_LONG_SQL = f"""
SELECT s.example_id, s.pos, s.vocab_id, s.s, t.t
FROM ({S_LONG}) s JOIN ({T_LONG}) t ON s.example_id = t.example_id AND s.pos = t.pos AND s.vocab_id = t.vocab_id"""


@register("pad_vocab_long", f"""
SELECT k.example_id, k.pos, n.n_vocab, round(k.kl, 6) AS kl FROM ({kl_long_sql(PAD_LONG_SQL, 2.0)}) k
JOIN (SELECT example_id, pos, CAST(count(*) AS BIGINT) AS n_vocab FROM ({PAD_LONG_SQL}) GROUP BY 1, 2) n
  ON n.example_id = k.example_id AND n.pos = k.pos""")
def q_pad_vocab_long(spark, d):
    s, t = _long_sides(spark, d)
    padded = lg.pad_vocab_long(s, t)
    n = padded.groupBy(*lg.KEYS).agg(F.count("*").cast("long").alias("n_vocab"))
    return lg.kl_long(padded, 2.0).join(n, lg.KEYS).select("example_id", "pos", "n_vocab", _r("kl").alias("kl"))


@register("truncate_vocab_long", f"""
SELECT example_id, pos, round(kl, 6) AS kl FROM ({kl_long_sql(TRUNC_LONG_SQL, 1.0)})""")
def q_truncate_vocab_long(spark, d):
    s, t = _long_sides(spark, d)
    return lg.kl_long(lg.truncate_vocab_long(s, t), 1.0).select("example_id", "pos", _r("kl").alias("kl"))


@register("softmax_long", f"""
WITH l AS (SELECT example_id, pos, unnest(range(len(logits))) AS vocab_id, unnest(logits) AS t FROM ({fx.TEACHER_LOGITS_SQL})),
m AS (SELECT example_id, pos, max(t) AS mt FROM l GROUP BY 1, 2),
e AS (SELECT l.example_id, l.pos, l.vocab_id, exp((l.t - m.mt) / 2.0) AS e FROM l JOIN m USING (example_id, pos))
SELECT example_id, pos, CAST(vocab_id AS INTEGER) AS vocab_id, round(e / sum(e) OVER (PARTITION BY example_id, pos), 6) AS p FROM e""")
def q_softmax_long(spark, d):
    t = lg.to_long(fx.teacher_logits(spark, d), "logits", "t")
    return lg.softmax_long(t, 2.0).select("example_id", "pos", F.col("vocab_id").cast("int").alias("vocab_id"),
                                          _r("p").alias("p"))


@register("selective_log_softmax_long", f"""
WITH l AS (SELECT example_id, pos, unnest(range(len(logits))) AS vocab_id, unnest(logits) AS t FROM ({fx.TEACHER_LOGITS_SQL})),
j AS (SELECT l.*, b.label FROM l JOIN ({fx.LABELS_SQL}) b USING (example_id, pos))
SELECT example_id, pos, round(max(t) FILTER (WHERE vocab_id = label) - (max(t) + ln(sum(exp(t - mx)) )) + 0.0, 6) AS lp
FROM (SELECT *, max(t) OVER (PARTITION BY example_id, pos) AS mx FROM j) GROUP BY 1, 2""")
def q_selective_log_softmax_long(spark, d):
    t = lg.to_long(fx.teacher_logits(spark, d), "logits", "t")
    return lg.selective_log_softmax_long(t, fx.labels_tok(spark, d)).select("example_id", "pos", _r("lp").alias("lp"))
