"""Distillation losses over stored teacher / student scores.

Scores are dense ``ARRAY<DOUBLE>`` rows keyed by (example_id, pos).  Pairing is an equi-join on
that key (sort-merge, or shuffle-free when both sides are bucketed / partitioned by
example_id); every reduction is a two-level hash aggregate (per example, then per batch), so no
``countDistinct`` and no group larger than one batch's examples.

``batchmean`` semantics: Σ over positions and vocabulary ÷ number of examples in the batch;
padding positions count (the default of the source scripts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc


def align_scores(student: DataFrame, teacher: DataFrame, keys=("example_id", "pos"),
                 s_col: str = "logits", t_col: str = "logits") -> DataFrame:
    """(keys…, s, t): student and teacher rows of the same (example, position)."""
    s = student.select(*keys, F.col(s_col).alias("s"))
    t = teacher.select(*keys, F.col(t_col).alias("t"))
    return s.join(t, list(keys), "inner")


def with_vocab_policy(df: DataFrame, policy: str = "pad") -> DataFrame:
    """Equalise vocab sizes: ``pad`` appends zeros to the shorter side, ``truncate`` cuts both."""
    if policy == "pad":
        s, t = sc.pad_vocab("s", "t")
    elif policy == "truncate":
        s, t = sc.truncate_vocab("s", "t")
    elif policy == "none":
        s, t = sc.as_double("s"), sc.as_double("t")
    else:
        raise ValueError(policy)
    return df.withColumn("s", s).withColumn("t", t)


def kl_rows(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    return df.withColumn("kl", sc.kl_row("s", "t", temperature))


def batch_kd(df: DataFrame, temperature: float = 1.0, batch_col: str = "batch_id",
             example_col: str = "example_id", scale: float = 1.0, mask: Column | None = None) -> DataFrame:
    """(batch_id, kd): batchmean KL · T² · scale.  Positions outside the (optional) ``mask`` count
    zero; their examples stay in the denominator."""
    rows = kl_rows(df, temperature)
    if mask is not None:
        rows = rows.withColumn("kl", F.when(mask, F.col("kl")).otherwise(0.0))
    per_ex = rows.groupBy(batch_col, example_col).agg(F.sum("kl").alias("_kl"))
    return per_ex.groupBy(batch_col).agg(
        (F.sum("_kl") / F.count("*") * (temperature ** 2) * scale).alias("kd"))


def hard_ce(logits: DataFrame, labels: DataFrame, keys=("example_id", "pos"), batch_col: str = "batch_id",
            ignore: int = -100, logits_col: str = "logits") -> DataFrame:
    """(batch_id, ce): token cross-entropy with the causal shift (logits at p predict label p+1),
    mean over the batch's non-ignored labels."""
    ex, pos = keys
    nxt = labels.select(ex, (F.col(pos) - 1).alias(pos), F.col("label").alias("_next"))
    j = logits.join(nxt, [ex, pos], "inner").where(F.col("_next") != ignore)
    tok = j.withColumn("_ce", -sc.selective_log_softmax(logits_col, "_next"))
    return tok.groupBy(batch_col).agg(F.avg("_ce").alias("ce"))


def next_labels(labels: DataFrame, keys=("example_id", "pos")) -> DataFrame:
    """(example_id, pos, next_label): the label each position predicts, under the key of its scores."""
    ex, pos = keys
    return labels.select(ex, (F.col(pos) - 1).cast(labels.schema[pos].dataType).alias(pos), F.col("label").alias("next_label"))


def kd_and_ce(pairs: DataFrame, following: DataFrame, policy: str = "pad", temperature: float = 1.0, scale: float = 1.0,
              batch_col: str = "batch_id", keys=("example_id", "pos"), ignore: int = -100, mask: Column | None = None) -> DataFrame:
    """(batch_id, kd, ce) from one reading of the pairs: ``batch_kd`` and ``hard_ce`` of the student in one
    aggregate.  ``following`` is ``next_labels``; a position without one has no CE but counts for KD."""
    both = pairs.join(following, list(keys), "left")
    target = F.when(F.col("next_label") != ignore, F.col("next_label"))
    both = both.withColumn("_ce", -sc.selective_log_softmax("s", target))      # the student as it is, before any policy
    rows = kl_rows(with_vocab_policy(both, policy), temperature)
    if mask is not None:
        rows = rows.withColumn("kl", F.when(mask, F.col("kl")).otherwise(0.0))
    per_ex = rows.groupBy(batch_col, keys[0]).agg(F.sum("kl").alias("_kl"), F.sum("_ce").alias("_ce"), F.count("_ce").alias("_n"))
    n = F.sum("_n")
    return per_ex.groupBy(batch_col).agg((F.sum("_kl") / F.count("*") * (temperature ** 2) * scale).alias("kd"),
                                         F.when(n > 0, F.sum("_ce") / F.nullif(n, F.lit(0))).alias("ce"))


def mixed(both: DataFrame, alpha: float, guard_missing_ce: bool = True) -> DataFrame:
    """``loss`` from columns ``kd`` and ``ce``: α·KD + (1−α)·CE; with the guard, without a hard loss α·KD only."""
    loss = alpha * F.col("kd") + (1 - alpha) * F.col("ce")
    return both.withColumn("loss", F.when(F.col("ce").isNull(), alpha * F.col("kd")).otherwise(loss) if guard_missing_ce else loss)


def mix_loss(kd: DataFrame, ce: DataFrame | None, alpha: float, batch_col: str = "batch_id",
             guard_missing_ce: bool = True) -> DataFrame:
    """α·KD + (1−α)·CE; with the guard, a batch without a hard loss gets α·KD only."""
    if ce is None:
        return kd.withColumn("ce", F.lit(None).cast("double")).withColumn("loss", alpha * F.col("kd"))
    return mixed(kd.join(ce, batch_col, "left"), alpha, guard_missing_ce)


def kd_loss_logits(pairs: DataFrame, ce: DataFrame | None, temperature: float = 2.0, alpha: float = 0.5,
                   max_length: int = 4096, batch_col: str = "batch_id", mask: Column | None = None,
                   following: DataFrame | None = None) -> DataFrame:
    """Logit-KD script: zero-padded vocab, batchmean KL · T² / max_length, α-mixed with CE.

    CE comes as a table ``ce``, or with ``following`` (see ``next_labels``) from the same pass over the pairs.
    ``mask`` (e.g. ``F.col('attention_mask') == 1``) leaves padding positions out; the source
    counts them, which is the default."""
    if following is not None:
        return mixed(kd_and_ce(pairs, following, "pad", temperature, 1.0 / max_length, batch_col, mask=mask), alpha, False)
    kd = batch_kd(with_vocab_policy(pairs, "pad"), temperature, batch_col, scale=1.0 / max_length, mask=mask)
    return mix_loss(kd, ce, alpha, batch_col, guard_missing_ce=False)


def kd_loss_plain(pairs: DataFrame, ce: DataFrame | None, temperature: float = 2.0, alpha: float = 0.5,
                  batch_col: str = "batch_id", mask: Column | None = None, following: DataFrame | None = None) -> DataFrame:
    """Control/cascade script: same without ÷max_length; no hard loss → α·KD."""
    if following is not None:
        return mixed(kd_and_ce(pairs, following, "pad", temperature, 1.0, batch_col, mask=mask), alpha)
    kd = batch_kd(with_vocab_policy(pairs, "pad"), temperature, batch_col, mask=mask)
    return mix_loss(kd, ce, alpha, batch_col, guard_missing_ce=True)


def kd_loss_dpo(pairs: DataFrame, temperature: float = 1.0, batch_col: str = "batch_id",
                mask: Column | None = None) -> DataFrame:
    """Preference script: batchmean KL · T² over the stacked chosen+rejected rows, no padding."""
    return batch_kd(with_vocab_policy(pairs, "none"), temperature, batch_col, mask=mask)


def kd_loss_debug(pairs: DataFrame, batch_col: str = "batch_id", mask: Column | None = None) -> DataFrame:
    """Smoke scripts: plain KL (T = 1) on vocabularies truncated to the common size."""
    return batch_kd(with_vocab_policy(pairs, "truncate"), 1.0, batch_col, mask=mask)


def response_kd_mse(df: DataFrame, student: str = "student_chosen", teacher: str = "teacher_chosen",
                    batch_col: str = "batch_id") -> DataFrame:
    """MSE between student and teacher chosen-sequence log-probs, per batch."""
    return df.groupBy(batch_col).agg(F.avg(F.pow(F.col(student) - F.col(teacher), 2)).alias("mse"))


def write_bucketed(df: DataFrame, table_name: str, buckets: int, keys=("example_id", "pos"), path: str | None = None) -> DataFrame:
    """Store scores bucketed and sorted by the alignment key, so the teacher ⋈ student join of
    two such tables (same bucket count) reads co-located files and shuffles neither side; only
    the per-position KL scalars are shuffled afterwards for the per-example sums.  A file a bucket is
    written (rows are brought together by bucket first).  ``path`` keeps the files outside the warehouse."""
    writer = (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet"))
    (writer.option("path", path) if path else writer).saveAsTable(table_name)
    return df.sparkSession.table(table_name)


def store_scores(student: DataFrame, teacher: DataFrame, labels: DataFrame, name: str, buckets: int, path: str | None = None) -> tuple:
    """Student scores, teacher scores and next labels as tables bucketed alike: (student, teacher, following).

    ``align_scores`` of the first two and ``kd_and_ce`` with the third then join without any exchange."""
    at = lambda part: f"{path.rstrip('/')}/{part}" if path else None
    return tuple(write_bucketed(df, f"{name}_{part}", buckets, path=at(part))
                 for part, df in (("student", student), ("teacher", teacher), ("following", next_labels(labels))))
