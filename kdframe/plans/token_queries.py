"""§2.3 vocabulary, encoding, truncation, padding, masks, labels, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import attention_mask, idiv, lm_labels, pad_ids, truncate_ids
from ..functions.chat import render_chatml, sharegpt_fixed_system
from ..operators import tokens as tk
from ..sources import fixtures as fx
from ..session import materialised
from ..sources.readers import table
from .registry import register
from .sqlparts import SHAREGPT, chatml_sql, fixed_messages_sql

VOCAB, TVOCAB = 4096, 1024
EOS = 1        # id of '<eos>' (specials '<unk>'=0, '<eos>'=1); no '<pad>' so pad = eos
N = 64


# the token pattern written again for the oracle: runs of word characters, or one other visible character
TOKEN_SQL = r"[_\pL\pN]+|[^_\pL\pN\x{9}-\x{d} ]"


def vocab_sql(size: int = VOCAB, src: str = "documents", col: str = "text") -> str:
    return f"""
SELECT token, CAST(id AS INTEGER) AS id FROM (VALUES ('<unk>', 0), ('<eos>', 1)) s(token, id)
UNION ALL
SELECT token, CAST(id AS INTEGER) AS id FROM (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({col}, '{TOKEN_SQL}')) AS token FROM {src})
        GROUP BY token)
  QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {size - 2})"""


def encode_sql(src: str, key: str, text: str, vocab: str) -> str:
    """(key, ids) with ids in token order, unknown → 0."""
    return f"""
SELECT s.{key} AS {key}, coalesce(e.ids, []::INTEGER[]) AS ids FROM ({src}) s LEFT JOIN (
  SELECT k, list(coalesce(v.id, 0) ORDER BY i) AS ids FROM (
    SELECT k, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS i
    FROM (SELECT {key} AS k, regexp_extract_all({text}, '{TOKEN_SQL}') AS toks FROM ({src}))) u
  LEFT JOIN ({vocab}) v ON v.token = u.token GROUP BY k) e ON e.k = s.{key}"""


def pad_sql(ids: str, n: int, pad: int, side: str = "right") -> str:
    t = f"({ids})[1:{n}]"
    rep = f"list_transform(range(greatest({n} - len({t}), 0)), lambda x: {pad})"
    return f"list_concat({rep}, {t})" if side == "left" else f"list_concat({t}, {rep})"


def mask_sql(ids: str, n: int, side: str = "right") -> str:
    t = f"({ids})[1:{n}]"
    ones = f"list_transform(range(len({t})), lambda x: 1)"
    zeros = f"list_transform(range(greatest({n} - len({t}), 0)), lambda x: 0)"
    return f"list_concat({zeros}, {ones})" if side == "left" else f"list_concat({ones}, {zeros})"


def j(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def sj(c):
    return F.array_join(c, " ")


def _docs(spark, d):
    return fx.lm_text(spark, d)


def _vocab(spark, d, size=VOCAB):
    return tk.fit_vocab(table(spark, d, "documents"), "text", size)


DOC_IDS = encode_sql("SELECT doc_id, text FROM documents", "doc_id", "text", vocab_sql())
BATCH = 8      # documents (conversations) that are padded together
BATCH_IDS = f"SELECT *, max(len(ids)) OVER (PARTITION BY doc_id // {BATCH}) AS n FROM ({DOC_IDS})"


@register("fit_vocab", vocab_sql())
def q_fit_vocab(spark, d):
    return _vocab(spark, d)


@register("encode", f"SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, {j('ids')} AS ids FROM ({DOC_IDS})")
def q_encode(spark, d):
    e = tk.encode(_docs(spark, d), "text", _vocab(spark, d))
    return e.select("doc_id", F.size("input_ids").cast("long").alias("n_ids"), sj("input_ids").alias("ids"))


@register("truncate_ids", f"SELECT doc_id, {j(f'ids[1:{N}]')} AS ids FROM ({DOC_IDS})")
def q_truncate_ids(spark, d):
    e = tk.encode(_docs(spark, d), "text", _vocab(spark, d))
    return e.select("doc_id", sj(truncate_ids("input_ids", N)).alias("ids"))


def _batched(spark, d):
    """Encoded documents with the longest length of their batch as ``_n``: padding goes up to it, nothing is cut."""
    e = tk.encode(_docs(spark, d), "text", _vocab(spark, d)).select("doc_id", "input_ids")
    return tk.batch_length(e, "input_ids", idiv("doc_id", BATCH))


@register("pad_ids", f"""
SELECT doc_id, {j(pad_sql('ids', 'n', EOS))} AS right_ids, {j(pad_sql('ids', 'n', EOS, 'left'))} AS left_ids
FROM ({BATCH_IDS})""")
def q_pad_ids(spark, d):
    e, n = _batched(spark, d), F.col("_n")
    return e.select("doc_id", sj(pad_ids("input_ids", n, EOS)).alias("right_ids"),
                    sj(pad_ids("input_ids", n, EOS, "left")).alias("left_ids"))


@register("attention_mask", f"""
SELECT doc_id, {j(mask_sql('ids', 'n'))} AS mask_right, {j(mask_sql('ids', 'n', 'left'))} AS mask_left
FROM ({BATCH_IDS})""")
def q_attention_mask(spark, d):
    e, n = _batched(spark, d), F.col("_n")
    return e.select("doc_id", sj(attention_mask("input_ids", n)).alias("mask_right"),
                    sj(attention_mask("input_ids", n, "left")).alias("mask_left"))


PAD_TOKENS = ("<pad>", ",", ".", "the", "des")      # one that no vocabulary has; the others' ids follow the corpus


@register("pad_id_default", f"""
SELECT p.token AS pad_token, coalesce(max(v.id) FILTER (WHERE v.token = p.token), max(v.id) FILTER (WHERE v.token = '<eos>')) AS pad_id,
       max(v.id) FILTER (WHERE v.token = '<eos>') AS eos_id
FROM (VALUES {', '.join(f"('{t}')" for t in PAD_TOKENS)}) p(token), ({vocab_sql()}) v GROUP BY 1""")
def q_pad_id_default(spark, d):
    vocab = materialised(_vocab(spark, d), "vocab")      # fitted once, read for each pad token
    rows = [tk.resolve_pad(vocab, pad_token=t).select(F.lit(t).alias("pad_token"), "pad_id", "eos_id") for t in PAD_TOKENS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _dual_src_sql():
    return (f"SELECT conv_id, {chatml_sql('m')} AS st, {chatml_sql('m', True, None, '<|start|>', '<|end|>')} AS tt "
            f"FROM (SELECT conv_id, {fixed_messages_sql()} AS m FROM ({SHAREGPT}))")


@register("dual_encode", f"""
SELECT conv_id, {j(pad_sql('si', 'sn', EOS))} AS input_ids, {j(mask_sql('si', 'sn'))} AS attention_mask,
       {j(pad_sql('ti', 'tn', EOS))} AS teacher_input_ids, {j(mask_sql('ti', 'tn'))} AS teacher_attention_mask
FROM (SELECT s.conv_id, s.ids AS si, t.ids AS ti, max(len(s.ids)) OVER (PARTITION BY s.conv_id // {BATCH}) AS sn,
             max(len(t.ids)) OVER (PARTITION BY s.conv_id // {BATCH}) AS tn
      FROM ({encode_sql(_dual_src_sql(), 'conv_id', 'st', vocab_sql())}) s
      JOIN ({encode_sql(_dual_src_sql(), 'conv_id', 'tt', vocab_sql(TVOCAB))}) t ON s.conv_id = t.conv_id)""")
def q_dual_encode(spark, d):
    m = sharegpt_fixed_system("conversations")
    src = fx.sharegpt(spark, d).select("conv_id", render_chatml(m, True).alias("st"),
                                       render_chatml(m, True, start="<|start|>", end="<|end|>",
                                                     default_system=None).alias("tt"))
    vocab = materialised(_vocab(spark, d), "vocab")
    # the smaller vocabulary is the head of the larger one: one fit, written once, serves both
    out = tk.dual_encode(src, "st", "tt", vocab, vocab.where(F.col("id") < TVOCAB), None, EOS, EOS,
                         batch=idiv("conv_id", BATCH))
    return out.select("conv_id", *[sj(c).alias(c) for c in
                                   ("input_ids", "attention_mask", "teacher_input_ids", "teacher_attention_mask")])


@register("lm_labels", f"""
SELECT doc_id, {j(f"list_transform(list_zip({pad_sql('ids', 'n', EOS)}, {mask_sql('ids', 'n')}), lambda x: CASE WHEN x[2] = 1 THEN x[1] ELSE -100 END)")} AS labels
FROM ({BATCH_IDS})""")
def q_lm_labels(spark, d):
    e = tk.encode_padded(_docs(spark, d), "text", _vocab(spark, d), None, EOS, batch=idiv("doc_id", BATCH))
    return e.select("doc_id", sj(lm_labels("input_ids", "attention_mask")).alias("labels"))


@register("pack_sequences", f"""
SELECT block_id, CAST(count(*) AS BIGINT) AS n_tokens, {j('list(id ORDER BY off)')} AS input_ids FROM (
  SELECT CAST((start + i - 1) // 1024 AS BIGINT) AS block_id, start + i - 1 AS off, ids[i] AS id FROM (
    SELECT ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM ({DOC_IDS})), LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS i))
GROUP BY block_id""")
def q_pack_sequences(spark, d):
    e = tk.encode(_docs(spark, d), "text", _vocab(spark, d))
    p = tk.pack_sequences(e, ["doc_id"], "input_ids", 1024, length=F.size(tk.tokenize("text")))
    return p.select("block_id", F.size("input_ids").cast("long").alias("n_tokens"), sj("input_ids").alias("input_ids"))
