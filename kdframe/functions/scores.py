"""Score expressions over dense logit arrays: softmax with temperature, KL, log-probs.

All arithmetic is DOUBLE.  KL is taken on log-softmax values (Σ exp(lt)·(lt − ls)), so no
logarithm of a probability is ever evaluated -- ``ln(0)`` would be NULL in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(x) -> Column:
    return F.transform(_col(x), lambda v: v.cast("double"))


def array_sum(x) -> Column:
    return F.aggregate(_col(x), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def _bind(a: Column, scalar: Column, fn) -> Column:
    """Apply ``fn(element, scalar)`` over ``a`` with the per-row scalar evaluated once.

    A lambda that names an outer expression re-evaluates it for every element (Spark does not
    eliminate common subexpressions inside lambdas), which makes softmax O(V²); repeating the
    scalar into an array first keeps it O(V).
    """
    return F.zip_with(a, F.array_repeat(scalar, F.size(a)), fn)


def _shifted(x, temperature: float) -> Column:
    """(x − max x) / T as DOUBLE."""
    a = as_double(x)
    return _bind(a, F.array_max(a), lambda v, m: (v - m) / temperature)


def logsumexp(x, temperature: float = 1.0) -> Column:
    """log Σ exp(x/T), shifted by the maximum for stability."""
    a = as_double(x)
    z = _shifted(a, temperature)
    return F.array_max(a) / temperature + F.log(F.aggregate(z, F.lit(0.0).cast("double"),
                                                            lambda acc, v: acc + F.exp(v)))


def log_softmax_t(x, temperature: float = 1.0) -> Column:
    z = _shifted(x, temperature)
    lse = F.log(F.aggregate(z, F.lit(0.0).cast("double"), lambda acc, v: acc + F.exp(v)))
    return _bind(z, lse, lambda v, l: v - l)


def softmax_t(x, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax_t(x, temperature), lambda v: F.exp(v))


def kl_row(student, teacher, temperature: float = 1.0) -> Column:
    """KL(p_t^T ‖ p_s^T) of one position = Σ p_t (log p_t − log p_s)."""
    lt = log_softmax_t(teacher, temperature)
    ls = log_softmax_t(student, temperature)
    return array_sum(F.zip_with(lt, ls, lambda p, q: F.exp(p) * (p - q)))


def pad_vocab(student, teacher):
    """Unequal vocab sizes: append zeros (mass exp(0), not -inf) to the shorter side."""
    s, t = as_double(student), as_double(teacher)
    zs = F.array_repeat(F.lit(0.0).cast("double"), F.greatest(F.size(t) - F.size(s), F.lit(0)))
    zt = F.array_repeat(F.lit(0.0).cast("double"), F.greatest(F.size(s) - F.size(t), F.lit(0)))
    return F.concat(s, zs), F.concat(t, zt)


def truncate_vocab(student, teacher):
    """Other policy: cut both sides to the smaller vocabulary."""
    s, t = _col(student), _col(teacher)
    n = F.least(F.size(s), F.size(t))
    return F.slice(as_double(s), 1, n), F.slice(as_double(t), 1, n)


def selective_log_softmax(logits, label) -> Column:
    """log p(label) = logits[label] − logsumexp(logits), without the full log-softmax.

    A label outside the vocabulary is an error, as it is for an index lookup; a null label or
    null logits give null."""
    a, at = as_double(logits), _col(label).cast("int")
    fits = (at >= 0) & (at < F.size(a))
    wrong = F.raise_error(F.concat(F.lit("label "), at.cast("string"), F.lit(" is outside the vocabulary")))
    return (F.when(at.isNull() | a.isNull(), F.lit(None).cast("double"))
            .when(fits, F.element_at(a, at + 1) - logsumexp(a)).otherwise(wrong.cast("double")))


def wpo_adjust(logits) -> Column:
    """logsumexp(2·log_softmax(logits)) = log Σ p², the WPO weight adjustment."""
    return logsumexp(F.transform(log_softmax_t(logits), lambda v: v * 2.0))


def dot(a, b) -> Column:
    return array_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))

