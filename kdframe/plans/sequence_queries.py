"""§2.5 sequence operators of the preference forward pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import sequences as sq
from ..sources import fixtures as fx
from .registry import register
from .sqlparts import DPO_PAIRS, dpo_prompt_sql
from .token_queries import encode_sql, vocab_sql

EOS = 1
TRUNC_N = 48


def keep_end_sql(x, n):
    return f"({x})[greatest(len({x}) - {n} + 1, 1):]"


def _pad(x, n, side):
    rep = f"list_transform(range(greatest({n} - len({x}), 0)), lambda q: {EOS})"
    return f"list_concat({rep}, {x})" if side == "left" else f"list_concat({x}, {rep})"


def _mask(x, n, side):
    ones = f"list_transform(range(len({x})), lambda q: 1)"
    zeros = f"list_transform(range(greatest({n} - len({x}), 0)), lambda q: 0)"
    return f"list_concat({zeros}, {ones})" if side == "left" else f"list_concat({ones}, {zeros})"


BATCH_SQL = f"f.pair_id // {fx.CONVS_PER_BATCH * fx.PAIR_STRIDE}"


def pt_sql(pairs: str = DPO_PAIRS, size: int = fx.VOCAB_SIZE, batch: str = BATCH_SQL) -> str:
    """Padded token rows of the pairs; ``batch`` is an expression over the formatted pairs f."""
    return f"""
WITH f AS (SELECT *, {dpo_prompt_sql()} AS prompt, chosen || '<|im_end|>n' AS yes,
                  rejected || '<|im_end|>n' AS no FROM ({pairs})),
src AS (SELECT pair_id * 3 AS k, prompt AS text FROM f UNION ALL SELECT pair_id * 3 + 1, yes FROM f
        UNION ALL SELECT pair_id * 3 + 2, no FROM f),
enc AS ({encode_sql('SELECT k, text FROM src', 'k', 'text', vocab_sql(size))}),
e AS (SELECT f.pair_id, {batch} AS batch_id, p.ids AS p, c.ids AS c, r.ids AS r
      FROM f JOIN enc p ON p.k = f.pair_id * 3 JOIN enc c ON c.k = f.pair_id * 3 + 1 JOIN enc r ON r.k = f.pair_id * 3 + 2),
b AS (SELECT *, max(len(p)) OVER (PARTITION BY batch_id) AS np, max(greatest(len(c), len(r))) OVER (PARTITION BY batch_id) AS nc FROM e)
SELECT batch_id, pair_id,
       {_pad('p', 'np', 'left')} AS prompt_ids, {_mask('p', 'np', 'left')} AS prompt_mask,
       {_pad('c', 'nc', 'right')} AS chosen_ids, {_mask('c', 'nc', 'right')} AS chosen_mask,
       {_pad('r', 'nc', 'right')} AS rejected_ids, {_mask('r', 'nc', 'right')} AS rejected_mask FROM b"""


def stack_sql(pairs: str) -> str:
    return f"""
WITH R AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pair_id) - 1 AS r,
                  count(*) OVER (PARTITION BY batch_id) AS n FROM ({pairs}))
SELECT batch_id, pair_id, 'chosen' AS side, r AS row, prompt_ids, prompt_mask, chosen_ids AS completion_ids,
       chosen_mask AS completion_mask FROM R
UNION ALL
SELECT batch_id, pair_id, 'rejected' AS side, r + n AS row, prompt_ids, prompt_mask, rejected_ids, rejected_mask FROM R"""


def concat_sql(stacked: str) -> str:
    return f"""
SELECT batch_id, pair_id, side, row, list_concat(prompt_ids, completion_ids) AS input_ids,
       list_concat(prompt_mask, completion_mask) AS attention_mask,
       list_concat(list_transform(prompt_mask, lambda x: 0), completion_mask) AS loss_mask FROM ({stacked})"""


def _rot(c):
    return f"CASE WHEN k < 0 THEN []::INTEGER[] ELSE list_concat({c}[k + 1:], {c}[1:k]) END AS {c}"


def flush_sql(joined: str) -> str:
    return f"""
WITH k AS (SELECT *, coalesce(list_position(attention_mask, 1), 0) - 1 AS k FROM ({joined})),
rot AS (SELECT batch_id, pair_id, side, row, {_rot('input_ids')}, {_rot('attention_mask')}, {_rot('loss_mask')} FROM k),
cells AS (SELECT batch_id, unnest(range(len(attention_mask))) AS c, unnest(attention_mask) AS m FROM rot),
cut AS (SELECT batch_id, coalesce(min(c) FILTER (WHERE mx = 0), max(c) + 1) AS cut
        FROM (SELECT batch_id, c, max(m) AS mx FROM cells GROUP BY 1, 2) GROUP BY 1)
SELECT rot.batch_id, pair_id, side, row, input_ids[1:coalesce(cut, 0)] AS input_ids,
       attention_mask[1:coalesce(cut, 0)] AS attention_mask, loss_mask[1:coalesce(cut, 0)] AS loss_mask
FROM rot LEFT JOIN cut ON cut.batch_id = rot.batch_id"""


STACK_SQL = stack_sql(pt_sql())
CONCAT_SQL = concat_sql(STACK_SQL)
FLUSH_SQL = flush_sql(CONCAT_SQL)

PACK_SQL = f"""
SELECT batch_id, list(i ORDER BY row, j) AS input_ids, list(pid ORDER BY row, j) AS position_ids,
       list(l ORDER BY row, j) AS loss_mask FROM (
  SELECT batch_id, row, j, i, l, row_number() OVER (PARTITION BY batch_id, row ORDER BY j) - 1 AS pid FROM (
    SELECT batch_id, row, unnest(range(len(input_ids))) AS j, unnest(input_ids) AS i, unnest(attention_mask) AS m,
           unnest(loss_mask) AS l FROM ({FLUSH_SQL})) WHERE m = 1)
GROUP BY batch_id"""


def j(x):
    return f"array_to_string({x}, ' ')"


def sj(c):
    return F.array_join(c, " ")


def _stacked(spark, d):
    return sq.stack_pairs(fx.pair_tokens(spark, d))


def _flushed(spark, d):
    return sq.flush_left(sq.concat_prompt_completion(_stacked(spark, d)))


SEQ3 = ("input_ids", "attention_mask", "loss_mask")


@register("stack_pairs", f"""
SELECT batch_id, pair_id, side, row, {j('completion_ids')} AS completion_ids FROM ({STACK_SQL})""")
def q_stack_pairs(spark, d):
    return _stacked(spark, d).select("batch_id", "pair_id", "side", "row", sj("completion_ids").alias("completion_ids"))


@register("concat_prompt_completion", f"""
SELECT pair_id, side, {j('input_ids')} AS input_ids, {j('attention_mask')} AS attention_mask, {j('loss_mask')} AS loss_mask
FROM ({CONCAT_SQL})""")
def q_concat_prompt_completion(spark, d):
    c = sq.concat_prompt_completion(_stacked(spark, d))
    return c.select("pair_id", "side", *[sj(x).alias(x) for x in SEQ3])


@register("flush_left", f"""
SELECT pair_id, side, {j('input_ids')} AS input_ids, {j('attention_mask')} AS attention_mask, {j('loss_mask')} AS loss_mask
FROM ({FLUSH_SQL})""")
def q_flush_left(spark, d):
    return _flushed(spark, d).select("pair_id", "side", *[sj(x).alias(x) for x in SEQ3])


@register("truncate_seq", f"""
SELECT pair_id, side, {j(keep_end_sql('input_ids', TRUNC_N))} AS input_ids, {j(keep_end_sql('loss_mask', TRUNC_N))} AS loss_mask,
       {j(f'attention_mask[1:{TRUNC_N}]')} AS attention_mask_start
FROM ({FLUSH_SQL})""")
def q_truncate_seq(spark, d):
    f = _flushed(spark, d)
    t = sq.truncate_rows(f, TRUNC_N, "keep_end", ("input_ids", "loss_mask"))
    t = sq.truncate_rows(t.withColumnRenamed("attention_mask", "attention_mask_start"), TRUNC_N, "keep_start",
                         ("attention_mask_start",))
    return t.select("pair_id", "side", sj("input_ids").alias("input_ids"), sj("loss_mask").alias("loss_mask"),
                    sj("attention_mask_start").alias("attention_mask_start"))


@register("logits_to_keep", f"""
WITH f AS ({FLUSH_SQL}),
s AS (SELECT *, list_concat(input_ids[2:], input_ids[1:1]) AS labels, list_concat(loss_mask[2:], loss_mask[1:1]) AS label_mask FROM f),
k AS (SELECT batch_id, CAST(max(len(loss_mask)) - min(list_position(loss_mask, 1) - 1) + 1 AS INTEGER) AS keep FROM f GROUP BY 1)
SELECT pair_id, side, keep AS logits_to_keep,
       {j('labels[greatest(len(labels) - keep + 1, 1) : greatest(len(labels) - keep + 1, 1) + keep - 1]')} AS labels,
       {j('label_mask[greatest(len(label_mask) - keep + 1, 1) : greatest(len(label_mask) - keep + 1, 1) + keep - 1]')} AS label_mask
FROM s JOIN k ON k.batch_id = s.batch_id""")
def q_logits_to_keep(spark, d):
    k = sq.logits_to_keep(_flushed(spark, d))
    return k.select("pair_id", "side", "logits_to_keep", sj("labels").alias("labels"), sj("label_mask").alias("label_mask"))


@register("pack_padding_free", f"""
SELECT batch_id, {j('input_ids')} AS input_ids, {j('position_ids')} AS position_ids, {j('loss_mask')} AS loss_mask
FROM ({PACK_SQL})""")
def q_pack_padding_free(spark, d):
    p = sq.pack_padding_free(_flushed(spark, d))
    return p.select("batch_id", sj("input_ids").alias("input_ids"), sj("position_ids").alias("position_ids"),
                    sj("loss_mask").alias("loss_mask"))


@register("unpack_padding_free", f"""
SELECT pair_id, side, {j("list_transform(list_zip(input_ids, attention_mask), lambda z: CASE WHEN z[2] = 1 THEN z[1] ELSE 0 END)")} AS input_ids
FROM ({FLUSH_SQL})""")
def q_unpack_padding_free(spark, d):
    packed = sq.pack_padding_free(_flushed(spark, d), keep=("pair_id", "side"))
    return sq.unpack_padding_free(packed).select("pair_id", "side", sj("input_ids").alias("input_ids"))


@register("split_packed", f"""
WITH p AS ({PACK_SQL}),
z AS (SELECT batch_id, i, row_number() OVER (PARTITION BY batch_id ORDER BY i) AS nth FROM (
        SELECT batch_id, unnest(range(len(position_ids))) AS i, unnest(position_ids) AS pid FROM p) WHERE pid = 0),
n AS (SELECT batch_id, count(DISTINCT pair_id) AS n_pairs FROM ({FLUSH_SQL}) GROUP BY 1)
SELECT p.batch_id, CAST(z.i AS INTEGER) AS split_idx FROM p JOIN n ON n.batch_id = p.batch_id
LEFT JOIN z ON z.batch_id = p.batch_id AND z.nth = n.n_pairs + 1""")
def q_split_packed(spark, d):
    packed = sq.pack_padding_free(_flushed(spark, d))
    return sq.split_packed(packed).select("batch_id", F.col("split_idx").cast("int").alias("split_idx"))


@register("shift_labels", f"""
SELECT pair_id, side, {j('list_concat(input_ids[2:], input_ids[1:1])')} AS labels,
       {j('list_concat(loss_mask[2:], loss_mask[1:1])')} AS label_mask FROM ({CONCAT_SQL})""")
def q_shift_labels(spark, d):
    s = sq.shift_labels(sq.concat_prompt_completion(_stacked(spark, d)))
    return s.select("pair_id", "side", sj("labels").alias("labels"), sj("label_mask").alias("label_mask"))


@register("tail_align_logits", f"""
WITH t AS ({fx.TEACHER_LOGITS_SQL}),
n AS (SELECT example_id, max(pos) + 1 AS n FROM t GROUP BY 1),
l AS (SELECT example_id, count(*) - 2 AS seq_len FROM ({fx.LABELS_SQL}) GROUP BY 1)
SELECT t.example_id, CAST(t.pos - greatest(n.n - l.seq_len, 0) AS INTEGER) AS pos, round(t.logits[1], 6) AS first_logit
FROM t JOIN n ON n.example_id = t.example_id JOIN l ON l.example_id = t.example_id
WHERE t.pos >= greatest(n.n - l.seq_len, 0)""")
def q_tail_align_logits(spark, d):
    lab = fx.labels_tok(spark, d).groupBy("example_id").agg((F.count("*") - 2).alias("seq_len"))
    t = sq.tail_align_logits(fx.teacher_logits(spark, d), lab)
    return t.select("example_id", "pos", F.round(F.element_at("logits", 1), 6).alias("first_logit"))


@register("selective_log_softmax", f"""
SELECT t.example_id, t.pos, round(t.logits[l.label + 1] - (list_max(t.logits) + ln(list_sum(list_transform(t.logits, lambda v: exp(v - list_max(t.logits)))))), 6) AS lp
FROM ({fx.TEACHER_LOGITS_SQL}) t JOIN ({fx.LABELS_SQL}) l ON l.example_id = t.example_id AND l.pos = t.pos""")
def q_selective_log_softmax(spark, d):
    t = fx.teacher_logits(spark, d).join(fx.labels_tok(spark, d), ["example_id", "pos"])
    return t.select("example_id", "pos", F.round(sc.selective_log_softmax("logits", "label"), 6).alias("lp"))
