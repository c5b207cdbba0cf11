"""Long-form scores: one row per (example_id, pos, vocab_id).

For stored top-k or very wide logits the dense arrays are exploded and every step is a
fully code-generated join or hash aggregate with map-side partial aggregation:
zero-padding of the shorter vocabulary is a full outer join, truncation an inner join,
softmax / KL a two-pass aggregate (maxima, then shifted sums), and the label log-prob a
conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["example_id", "pos"]


def to_long(df: DataFrame, col: str, name: str, keys=KEYS) -> DataFrame:
    """(keys…, vocab_id, name) from a dense array column."""
    return df.select(*keys, F.posexplode(col).alias("vocab_id", name)).withColumn(name, F.col(name).cast("double"))


def pad_vocab_long(student: DataFrame, teacher: DataFrame, keys=KEYS) -> DataFrame:
    """Full outer join on (keys, vocab_id); a side missing a vocab id contributes logit 0."""
    j = student.join(teacher, [*keys, "vocab_id"], "full_outer")
    return j.select(*keys, "vocab_id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("t", F.lit(0.0)).alias("t"))


def truncate_vocab_long(student: DataFrame, teacher: DataFrame, keys=KEYS) -> DataFrame:
    """Inner join on (keys, vocab_id): only ids both vocabularies have."""
    return student.join(teacher, [*keys, "vocab_id"], "inner")


def kl_long(pairs: DataFrame, temperature: float = 1.0, keys=KEYS) -> DataFrame:
    """(keys…, kl) with KL = Σ p_t (t − s)/T − LSE_t + LSE_s, LSE = max/T + ln Σ exp((x − max)/T)."""
    T = float(temperature)
    mx = pairs.groupBy(*keys).agg(F.max("t").alias("_mt"), F.max("s").alias("_ms"))
    j = pairs.join(mx, keys)
    et = F.exp((F.col("t") - F.col("_mt")) / T)
    agg = j.groupBy(*keys).agg(F.first("_mt").alias("_mt"), F.first("_ms").alias("_ms"),
                               F.sum(et).alias("_zt"), F.sum(F.exp((F.col("s") - F.col("_ms")) / T)).alias("_zs"),
                               F.sum(et * (F.col("t") - F.col("s")) / T).alias("_b"))
    lse_t = F.col("_mt") / T + F.log("_zt")
    lse_s = F.col("_ms") / T + F.log("_zs")
    return agg.select(*keys, (F.col("_b") / F.col("_zt") - lse_t + lse_s).alias("kl"))


def softmax_long(logits: DataFrame, temperature: float = 1.0, keys=KEYS, col: str = "t") -> DataFrame:
    """(keys…, vocab_id, p) — two-pass: maximum, then shifted exponent sums."""
    T = float(temperature)
    mx = logits.groupBy(*keys).agg(F.max(col).alias("_m"))
    j = logits.join(mx, keys).withColumn("_e", F.exp((F.col(col) - F.col("_m")) / T))
    z = j.groupBy(*keys).agg(F.sum("_e").alias("_z"))
    return j.join(z, keys).select(*keys, "vocab_id", (F.col("_e") / F.col("_z")).alias("p"))


def selective_log_softmax_long(logits: DataFrame, labels: DataFrame, keys=KEYS, col: str = "t") -> DataFrame:
    """(keys…, lp): logit of the label (conditional aggregate) minus logsumexp."""
    j = logits.join(labels.select(*keys, "label"), keys)
    mx = j.groupBy(*keys).agg(F.max(col).alias("_m"))
    jj = j.join(mx, keys)
    agg = jj.groupBy(*keys).agg(F.first("_m").alias("_m"), F.sum(F.exp(F.col(col) - F.col("_m"))).alias("_z"),
                                F.max(F.when(F.col("vocab_id") == F.col("label"), F.col(col))).alias("_sel"))
    return agg.select(*keys, (F.col("_sel") - F.col("_m") - F.log("_z")).alias("lp"))
