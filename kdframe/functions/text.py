"""Prompt building and answer extraction as column expressions.

Patterns use explicit character classes so that the JVM and the DuckDB oracle (RE2) agree, and
so that they follow Python's ``str`` semantics of the source: a word character is a letter, a
number or ``_``; whitespace for ``strip`` is Python's ``str.isspace`` set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STOP_SEQS

# Character classes.
WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"
PY_SPACE = (r"[\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
            r"\x{202f}\x{205f}\x{3000}]")
LETTER_RE = r"(^|" + NONWORD + r")([A-D])(" + NONWORD + r"|$)"
KEYWORD_RE = r"(?i)(choice|answer)(?::|" + PY_SPACE + r")*([A-Da-d])"
LAST_INT_REVERSED_RE = r"[0-9]+-?"
PY_SPACES = ("\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
             "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace); Spark ``trim`` alone removes spaces only."""
    return F.trim(_col(c), F.lit(PY_SPACES))


def zero_shot_prompt(q) -> Column:
    return F.concat(F.lit("Question: "), _col(q), F.lit("\nAnswer:"))


def format_choices(choices) -> Column:
    """``A) x\\nB) y…`` lettered by position."""
    return F.array_join(F.transform(_col(choices), lambda x, i: F.concat(F.chr(i + 65), F.lit(") "),
                                                                          F.coalesce(x, F.lit("")))), "\n")


def truncate_at_stop(text, stops=STOP_SEQS, cleanup: bool = True) -> Column:
    """Cut at the earliest stop sequence, then strip; null / empty → ''."""
    t = F.coalesce(_col(text), F.lit(""))
    if not cleanup:
        return t
    hits = [F.when(F.contains(t, F.lit(s)), F.instr(t, s)) for s in stops]     # contains() goes by bytes, instr() by characters
    pos = F.least(*hits) if len(hits) > 1 else hits[0]          # least() skips nulls; no lambda
    cut = F.when(pos.isNull(), t).otherwise(t.substr(F.lit(1), pos - 1))
    return py_strip(cut)


def extract_last_integer(text) -> Column:
    """Last ``-?\\d+`` after removing commas, as a canonical integer string (sign, no leading zeros,
    ``-0`` → ``0``) so that unbounded integers compare exactly; none / null → null.

    The text is read from its end, where the last integer is the first, so a long text is not searched whole."""
    backwards = F.reverse(F.replace(_col(text), F.lit(","), F.lit("")))
    last = F.nullif(F.reverse(F.regexp_extract(backwards, LAST_INT_REVERSED_RE, 0)), F.lit(""))
    # of what is found, short as it is, the leading zeros go, and the sign where nothing but a zero is left
    return F.regexp_replace(F.regexp_replace(last, "^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")


def extract_choice_letter(text) -> Column:
    """First standalone A–D of the upper-cased text; else ``(choice|answer)[:\\s]*([A-D])``
    case-insensitively on the original; else null."""
    t = _col(text)
    first = F.nullif(F.regexp_extract(F.upper(t), LETTER_RE, 2), F.lit(""))
    # one search of the text (null without a match), where nullif() would make a second one
    second = F.upper(F.try_element_at(F.regexp_extract_all(t, F.lit(KEYWORD_RE), F.lit(2)), F.lit(1)))
    return F.coalesce(first, second)


def _word_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD + "+"), 0))


def match_choice_by_text(gen, choices) -> Column:
    """First choice contained in the lower-cased text; else the best Jaccard overlap of word sets
    (first maximum wins) if it exceeds 0.1; else null.  Empty text or choices → null.

    Per-row values used inside lambdas (the lower-cased text, its word set) are repeated into
    arrays first so each is computed once per row, not once per choice, and each step is read once
    by the next.  A text is taken apart into words only if a word of a choice occurs in it."""
    g, ch = _col(gen), _col(choices)
    n = F.size(ch)
    low = F.array_repeat(F.lower(g), n)
    hits = F.filter(F.zip_with(F.zip_with(ch, low, lambda c, t: F.struct(c.alias("c"), t.alias("t"))),
                               F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                               lambda x, i: F.struct(i.alias("i"), x["c"].alias("c"), x["t"].alias("t"))),
                    lambda x: x["c"].isNotNull() & (x["c"] != "") & F.contains(x["t"], F.lower(x["c"])))
    named = F.try_element_at(F.transform(hits, lambda x: F.chr(x["i"] + 65)), F.lit(1))
    csets = F.transform(ch, lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(_word_set(c)))
    shares = F.exists(F.zip_with(csets, low, lambda cs, t: F.exists(cs, lambda w: F.contains(t, w))), lambda x: x)
    sets = F.zip_with(csets, F.array_repeat(_word_set(g), n), lambda cs, gs: F.struct(
        F.size(cs).alias("c"), F.size(gs).alias("g"), F.size(F.array_intersect(gs, cs)).alias("both")))
    jac = F.transform(sets, lambda x, i: F.struct(
        F.when((x["c"] == 0) | (x["g"] == 0), F.lit(0.0)).otherwise(x["both"] / F.greatest(F.lit(1), x["c"] + x["g"] - x["both"])).alias("s"),
        (-i).alias("ni")))
    best = F.filter(F.array(F.array_max(jac)), lambda x: x["s"] > 0.1)
    alike = F.try_element_at(F.transform(best, lambda x: F.chr(65 - x["ni"])), F.lit(1))
    empty = g.isNull() | (g == "") | ch.isNull() | (n == 0)
    return F.when(~empty, F.coalesce(named, F.when(shares, alike)))


def predict_choice(gen, choices) -> Column:
    """Letter first; if none and there are choices, the text match."""
    return F.coalesce(extract_choice_letter(gen), match_choice_by_text(gen, choices))


def model_label(name, label=None, suffix: str = "") -> Column:
    """Label defaults to the model name with '/' → '_'; optional ``_control`` / ``_cascade`` suffix."""
    base = F.coalesce(_col(label), F.regexp_replace(_col(name), "/", "_")) if label is not None else \
        F.regexp_replace(_col(name), "/", "_")
    return F.concat(base, F.lit(suffix)) if suffix else base


def strip_prompt(out_ids, prompt_ids) -> Column:
    """Continuation only: drop the first len(prompt) output tokens."""
    o, p = _col(out_ids), _col(prompt_ids)
    return F.slice(o, F.size(p) + 1, F.greatest(F.size(o) - F.size(p), F.lit(0)))
