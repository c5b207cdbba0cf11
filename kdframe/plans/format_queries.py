"""§2.2 chat and preference formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chat import render_chatml, sharegpt_fixed_system, sharegpt_to_messages
from ..operators.conversations import collect_conversations, dpo_format, drop_source_columns
from ..sources import fixtures as fx
from ..sources.readers import table
from .registry import register
from .sqlparts import DPO_PAIRS, NL, SHAREGPT, chatml_sql, dpo_prompt_sql, fixed_messages_sql, messages_sql

TEACHER_FMT = dict(start="<|start|>", end="<|end|>", default_system=None)


def _msg_view(m):
    return (F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"),
            F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n").alias("body"))


def _msg_view_sql(m):
    return (f"array_to_string(list_transform({m}, lambda x: x.role), ',') AS roles, "
            f"array_to_string(list_transform({m}, lambda x: x.role || ':' || x.content), {NL}) AS body")


@register("collect_conversations", f"""
SELECT conv_id, CAST(len(conversations) AS BIGINT) AS n_turns,
       array_to_string(list_transform(conversations, lambda x: x['from'] || ':' || x['value']), {NL}) AS flat
FROM ({SHAREGPT})""")
def q_collect_conversations(spark, d):
    c = collect_conversations(table(spark, d, "conversations"))
    return c.select("conv_id", F.size("conversations").cast("long").alias("n_turns"),
                    F.array_join(F.transform("conversations", lambda x: F.concat(x["from"], F.lit(":"), x["value"])),
                                 "\n").alias("flat"))


@register("sharegpt_to_messages", f"""
SELECT conv_id, {_msg_view_sql('m')} FROM (SELECT conv_id, {messages_sql()} AS m FROM ({SHAREGPT}))""")
def q_sharegpt_to_messages(spark, d):
    m = sharegpt_to_messages("conversations")
    return fx.sharegpt(spark, d).select("conv_id", *_msg_view(m))


@register("sharegpt_fixed_system", f"""
SELECT conv_id, {_msg_view_sql('m')} FROM (SELECT conv_id, {fixed_messages_sql()} AS m FROM ({SHAREGPT}))""")
def q_sharegpt_fixed_system(spark, d):
    m = sharegpt_fixed_system("conversations")
    return fx.sharegpt(spark, d).select("conv_id", *_msg_view(m))


@register("render_chatml", f"""
SELECT conv_id, {chatml_sql('m')} AS text FROM (SELECT conv_id, {messages_sql()} AS m FROM ({SHAREGPT}))""")
def q_render_chatml(spark, d):
    return fx.sharegpt(spark, d).select(
        "conv_id", render_chatml(sharegpt_to_messages("conversations"), True).alias("text"))


@register("dual_render", f"""
SELECT conv_id, {chatml_sql('m')} AS student_text,
       {chatml_sql('m', True, None, '<|start|>', '<|end|>')} AS teacher_text
FROM (SELECT conv_id, {fixed_messages_sql()} AS m FROM ({SHAREGPT}))""")
def q_dual_render(spark, d):
    m = sharegpt_fixed_system("conversations")
    return fx.sharegpt(spark, d).select("conv_id", render_chatml(m, True).alias("student_text"),
                                        render_chatml(m, True, **TEACHER_FMT).alias("teacher_text"))


@register("dpo_format", f"""
SELECT pair_id, {dpo_prompt_sql()} AS prompt, chosen || '<|im_end|>n' AS chosen,
       rejected || '<|im_end|>n' AS rejected FROM ({DPO_PAIRS})""")
def q_dpo_format(spark, d):
    return dpo_format(fx.dpo_pairs(spark, d))


@register("drop_source_columns", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_text_chars, upper(lang) AS lang_tag FROM documents""")
def q_drop_source_columns(spark, d):
    docs = table(spark, d, "documents")
    return drop_source_columns(docs, {"n_text_chars": F.length("text").cast("long"),
                                      "lang_tag": F.upper("lang")}, keep=["doc_id"])
