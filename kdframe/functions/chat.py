"""Chat formatting as column expressions: ShareGPT → messages → ChatML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_SYSTEM, DPO_SUFFIX, FIXED_SYSTEM, IM_END, IM_START

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _msg(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def _empty_messages() -> Column:
    return F.array().cast("array<struct<role:string,content:string>>")


def sharegpt_to_messages(conversations, default_system: str | None = DEFAULT_SYSTEM) -> Column:
    """human→user, gpt→assistant; system turns are inserted at the front (so several end up
    reversed); other speakers dropped; missing value → ''; no system → default prepended."""
    conv = _col(conversations)
    sys = F.reverse(F.filter(conv, lambda x: x["from"] == "system"))
    rest = F.filter(conv, lambda x: x["from"].isin("human", "gpt"))
    sys_m = F.transform(sys, lambda x: _msg(F.lit("system"), x["value"]))
    rest_m = F.transform(rest, lambda x: _msg(F.when(x["from"] == "human", "user").otherwise("assistant"),
                                                x["value"]))
    msgs = F.concat(sys_m, rest_m)
    msgs = F.coalesce(msgs, _empty_messages())
    if default_system is None:
        return msgs
    default = F.array(_msg(F.lit("system"), F.lit(default_system)))
    return F.when(F.size(F.coalesce(sys, F.array())) > 0, msgs).otherwise(F.concat(default, msgs))


def sharegpt_fixed_system(conversations, system: str = FIXED_SYSTEM) -> Column:
    """Constant system prompt first; the input's own system turns are dropped."""
    conv = _col(conversations)
    rest = F.filter(conv, lambda x: x["from"].isin("human", "gpt"))
    rest_m = F.transform(rest, lambda x: _msg(F.when(x["from"] == "human", "user").otherwise("assistant"),
                                                x["value"]))
    return F.concat(F.array(_msg(F.lit("system"), F.lit(system))), F.coalesce(rest_m, _empty_messages()))


def render_chatml(messages, add_generation_prompt: bool = True, default_system: str | None = DEFAULT_SYSTEM,
                  start: str = IM_START, end: str = IM_END, generation_role: str = "assistant") -> Column:
    """ChatML text: default system block when the first message is not system (and there is a
    first message); each message ``start+role\\ncontent+end\\n``; optional generation prompt."""
    m = _col(messages)
    body = F.array_join(F.transform(m, lambda x: F.concat(F.lit(start), F.coalesce(x["role"], F.lit("")),
                                                           F.lit("\n"), F.coalesce(x["content"], F.lit("")),
                                                           F.lit(end + "\n"))), "")
    parts = []
    if default_system is not None:
        first_role = F.try_element_at(m, F.lit(1))["role"]
        parts.append(F.when((F.size(m) > 0) & (F.coalesce(first_role, F.lit("")) != "system"),
                            F.lit(f"{start}system\n{default_system}{end}\n")).otherwise(F.lit("")))
    parts.append(F.coalesce(body, F.lit("")))
    if add_generation_prompt:
        parts.append(F.lit(f"{start}{generation_role}\n"))
    return F.concat(*parts)


def dpo_prompt(system, question, default_system: str | None = DEFAULT_SYSTEM,
               start: str = IM_START, end: str = IM_END) -> Column:
    """System rendered alone (no generation prompt) when non-empty, then the user question
    rendered alone with the generation prompt; two template calls, concatenated.  The second
    call starts with a user message, so a template with a default system block emits it too."""
    s = F.coalesce(_col(system), F.lit(""))
    sys_text = F.when(F.length(s) > 0, F.concat(F.lit(f"{start}system\n"), s, F.lit(f"{end}\n"))).otherwise(F.lit(""))
    default = F.lit(f"{start}system\n{default_system}{end}\n" if default_system is not None else "")
    user = F.concat(F.lit(f"{start}user\n"), F.coalesce(_col(question), F.lit("")), F.lit(f"{end}\n{start}assistant\n"))
    return F.concat(sys_text, default, user)


def dpo_completion(text, suffix: str = DPO_SUFFIX) -> Column:
    """Completion + literal suffix (the default keeps the source's ``<|im_end|>n``)."""
    return F.concat(_col(text), F.lit(suffix))
