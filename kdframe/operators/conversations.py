"""Conversation-level operators: long turns → nested ShareGPT rows, formatting maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_SYSTEM, DPO_SUFFIX
from ..functions.chat import dpo_completion, dpo_prompt, render_chatml, sharegpt_to_messages

def collect_conversations(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role",
                          text_col="text") -> DataFrame:
    """(conv_id, turn, role, text) → (conv_id, conversations ARRAY<STRUCT<from, value>>) in turn order.

    One hash-aggregate on conv_id; a group is one conversation, bounded by its own turns.
    """
    frm = (F.when(F.col(role_col) == "user", "human").when(F.col(role_col) == "assistant", "gpt")
           .otherwise(F.col(role_col)))
    agg = turns.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), frm.alias("from"),
                                             F.col(text_col).alias("value")))).alias("_t"))
    return agg.select(conv_col, F.transform("_t", lambda x: F.struct(x["from"].alias("from"),
                                                                    x["value"].alias("value"))).alias("conversations"))


def format_sharegpt(df: DataFrame, keep=("conv_id",), conv_col: str = "conversations",
                    default_system: str | None = DEFAULT_SYSTEM) -> DataFrame:
    """Map of the logit-KD script: conversations → ChatML ``text``; source columns dropped."""
    return df.select(*keep, render_chatml(sharegpt_to_messages(conv_col, default_system), True,
                                          default_system).alias("text"))


def dpo_format(df: DataFrame, keep=("pair_id",), suffix: str = DPO_SUFFIX,
               default_system: str | None = DEFAULT_SYSTEM) -> DataFrame:
    """(system, question, chosen, rejected) → (prompt, chosen, rejected)."""
    return df.select(*keep, dpo_prompt("system", "question", default_system).alias("prompt"),
                     dpo_completion("chosen", suffix).alias("chosen"),
                     dpo_completion("rejected", suffix).alias("rejected"))


def drop_source_columns(df: DataFrame, produced: dict, keep=()) -> DataFrame:
    """``map(fn, remove_columns=...)``: only the produced columns (plus keys) survive; Catalyst
    then prunes every unused source column from the scan."""
    return df.select(*keep, *[c.alias(n) for n, c in produced.items()])
