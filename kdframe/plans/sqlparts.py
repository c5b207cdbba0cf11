"""SQL fragments shared by the DuckDB oracles (same derivations as the DataFrame code)."""

from ..config import DEFAULT_SYSTEM, FIXED_SYSTEM
from ..sources import fixtures as fx

NL = "chr(10)"


def md5_key(seed, *cols) -> str:
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5({inner})"


def messages_sql(conv: str = "conversations", default_system: str | None = DEFAULT_SYSTEM) -> str:
    sys = (f"list_transform(list_reverse(list_filter({conv}, lambda x: x['from'] = 'system')), "
           f"lambda x: {{'role': 'system', 'content': coalesce(x['value'], '')}})")
    rest = (f"list_transform(list_filter({conv}, lambda x: x['from'] IN ('human', 'gpt')), "
            f"lambda x: {{'role': CASE WHEN x['from'] = 'human' THEN 'user' ELSE 'assistant' END, "
            f"'content': coalesce(x['value'], '')}})")
    if default_system is None:
        return f"list_concat({sys}, {rest})"
    return (f"CASE WHEN len(list_filter({conv}, lambda x: x['from'] = 'system')) > 0 "
            f"THEN list_concat({sys}, {rest}) "
            f"ELSE list_concat([{{'role': 'system', 'content': '{default_system}'}}], {rest}) END")


def fixed_messages_sql(conv: str = "conversations", system: str = FIXED_SYSTEM) -> str:
    rest = (f"list_transform(list_filter({conv}, lambda x: x['from'] IN ('human', 'gpt')), "
            f"lambda x: {{'role': CASE WHEN x['from'] = 'human' THEN 'user' ELSE 'assistant' END, "
            f"'content': coalesce(x['value'], '')}})")
    return f"list_concat([{{'role': 'system', 'content': '{system}'}}], {rest})"


def chatml_sql(m: str, gen: bool = True, default_system: str | None = DEFAULT_SYSTEM,
               start: str = "<|im_start|>", end: str = "<|im_end|>") -> str:
    body = (f"array_to_string(list_transform({m}, lambda x: '{start}' || coalesce(x.role, '') || {NL} || "
            f"coalesce(x.content, '') || '{end}' || {NL}), '')")
    parts = []
    if default_system is not None:
        parts.append(f"(CASE WHEN len({m}) > 0 AND coalesce(({m})[1].role, '') <> 'system' "
                     f"THEN '{start}system' || {NL} || '{default_system}{end}' || {NL} ELSE '' END)")
    parts.append(f"coalesce({body}, '')")
    if gen:
        parts.append(f"'{start}assistant' || {NL}")
    return " || ".join(parts)


def dpo_prompt_sql(system: str = "system", question: str = "question") -> str:
    sys_msgs = f"[{{'role': 'system', 'content': coalesce({system}, '')}}]"
    user_msgs = f"[{{'role': 'user', 'content': {question}}}]"
    return (f"(CASE WHEN length(coalesce({system}, '')) > 0 THEN {chatml_sql(sys_msgs, False)} ELSE '' END) || "
            f"{chatml_sql(user_msgs, True)}")


SHAREGPT = fx.SHAREGPT_SQL
DPO_PAIRS = fx.DPO_PAIRS_SQL
