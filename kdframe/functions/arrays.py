"""Token-array expressions: truncation, padding, masks, labels, rolls (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IGNORE_INDEX


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(c, n) -> Column:
    """Exact floor division of integers (``c - pmod(c, n)`` is a multiple of n, so ``div`` is
    exact); unlike ``floor(c / n)`` it never goes through DOUBLE, so ids beyond 2^53 stay exact."""
    c = _col(c).cast("long")
    n = (F.lit(n) if not isinstance(n, Column) else n).cast("long")
    return F.call_function("div", c - F.pmod(c, n), n)


def truncate_ids(ids, n: int) -> Column:
    """``truncation=True, max_length=n``: keep the first n tokens."""
    return F.slice(_col(ids), 1, n)


def keep_end(ids, n: int) -> Column:
    """Last n elements (``x[-n:]``)."""
    a = _col(ids)
    return F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1), F.lit(n))


def keep_start(ids, n: int) -> Column:
    return F.slice(_col(ids), 1, n)


def truncate_seq(ids, n: int, mode: str = "keep_end") -> Column:
    if mode == "keep_end":
        return keep_end(ids, n)
    if mode == "keep_start":
        return keep_start(ids, n)
    raise ValueError(f"truncation mode {mode!r}: only keep_end and keep_start are known")


def pad_ids(ids, n: int, pad_id, side: str = "right") -> Column:
    """``padding='max_length'``: pad to n with ``pad_id`` on the right (default) or left."""
    a = _col(ids)
    pad = F.array_repeat(F.lit(pad_id) if not isinstance(pad_id, Column) else pad_id,
                         F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(pad, a) if side == "left" else F.concat(a, pad)


def attention_mask(ids, n: int, side: str = "right") -> Column:
    """1 for each real token of ``ids`` (already truncated, not yet padded), 0 for padding."""
    a = _col(ids)
    ones = F.array_repeat(F.lit(1), F.size(a))
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)


def lm_labels(ids, mask, ignore: int = IGNORE_INDEX) -> Column:
    """Hard labels: the id where mask = 1, the ignore index elsewhere."""
    return F.zip_with(_col(ids), _col(mask), lambda i, m: F.when(m == 1, i).otherwise(F.lit(ignore)))


def roll_left(a) -> Column:
    """``torch.roll(x, -1)``: first element moves to the end."""
    a = _col(a)
    return F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))


def roll_right(a) -> Column:
    """``torch.roll(x, 1)``: last element moves to the front."""
    a = _col(a)
    return F.when(F.size(a) == 0, a).otherwise(
        F.concat(F.slice(a, -1, 1), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))))


def rotate_left(a, k) -> Column:
    """Rotate left by k (0 <= k < size)."""
    a = _col(a)
    k = F.lit(k) if not isinstance(k, Column) else k
    return F.concat(F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))), F.slice(a, 1, k))


def zeros_like(a) -> Column:
    return F.array_repeat(F.lit(0), F.size(_col(a)))


def first_one(mask) -> Column:
    """0-based index of the first 1 in the mask, -1 when there is none."""
    return F.array_position(_col(mask), 1) - 1


def runs_of_ones(mask) -> Column:
    """The runs of ones of a mask, in order, as structs (start, stop), stop exclusive."""
    m = _col(mask)
    size, none = F.greatest(F.size(m) - 1, F.lit(0)), F.array(F.lit(0))

    def edges(neighbours: Column, step: int) -> Column:
        at = F.zip_with(m, neighbours, lambda x, y: (x == 1) & (y != 1))
        return F.filter(F.transform(at, lambda edge, i: F.when(edge, i + step)), lambda i: i.isNotNull())

    starts, stops = edges(F.concat(none, F.slice(m, 1, size)), 0), edges(F.concat(F.slice(m, 2, size), none), 1)
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def scatter(values, mask) -> Column:
    """``values`` put in order where the mask is 1, 0 elsewhere: one slice a run of ones."""
    kind = "struct<out:array<int>,at:int,used:int>"
    begin = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("used")).cast(kind)

    def put(acc: Column, run: Column) -> Column:
        size = run["stop"] - run["start"]
        out = F.concat(acc["out"], F.array_repeat(F.lit(0), run["start"] - acc["at"]), F.slice(_col(values), acc["used"] + 1, size))
        return F.struct(out.alias("out"), run["stop"].alias("at"), (acc["used"] + size).alias("used")).cast(kind)

    m = _col(mask)
    return F.aggregate(runs_of_ones(m), begin, put, lambda acc: F.concat(acc["out"], F.array_repeat(F.lit(0), F.size(m) - acc["at"])))
