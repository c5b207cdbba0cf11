"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document has the same expected number of copies, target / source size.
Documents stand in a fixed order, their expected copies are summed up along it, one offset per
source is added, and a document is emitted once for each integer its span of the sum crosses.
The order is by size class first, so the words taken follow the target closely, and by a hash
of the id inside a class, so ids in any order give an even pick.

The position of a document in its source is never found by one sort of the source: counts per
(source, size class, hash bucket) give each bucket its start, and only rows of one bucket are
ranked together.  A source with a third of all rows is spread over up to 4096 buckets a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_TIMES = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Monotone class of a size: exact below 64, then 64 classes for each doubling."""
    top = F.length(F.bin(size)) - 1
    return F.when(size < 64, size).otherwise(
        64 * top + F.expr("shiftright(size, length(bin(size)) - 7)") - 64).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """``(skey, source_size, target, rate)`` from ``sizes(skey, source, size)``.

    One row per source.  Sources take the weights in turn in code-point order, null last.  All
    sizes together are shared by weight; a source stops at ``max_times`` its own size and its
    excess is shared again by weight.  That settles at one common level: going through the
    sources by cap / weight, a source is capped while the level of those still open is above it.
    """
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_times)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_w = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    per = per.withColumn("level", (total - before) / open_w)
    per = per.withColumn("capped", F.col("cap") / F.col("w") < F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("w")))
    rate = (F.when(F.col("source_size") == 0, 0.0).when(F.col("capped"), float(max_times))
            .otherwise(F.col("target") / F.col("source_size")))
    return per.select("skey", "source_size", "target", rate.alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, source, text_hash, size, source_size, target,
    copies, taken)``, where ``copies`` is how often the mix emits the document.

    Size is the number of words (null or blank text: 0, and nothing is taken).  A null source is
    a source of its own, after all others.  Null ids take part and are ordered as an empty id;
    repeated rows are rows of their own and share their copies in a fixed way.  No document is
    emitted more than ``max_times`` times.  A table without rows or words gives targets of 0.
    The same rows give the same result on every run and partitioning.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    rows = (rows.withColumn("skey", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")))
            .withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), ident)))
            .withColumn("cls", size_class(F.col("size"))).withColumn("bucket", F.substring("h", 1, 3)))
    rows = written(rows, "mix")
    bucket = rows.groupBy("skey", "cls", "bucket").agg(F.count(F.lit(1)).alias("n"))
    cls = bucket.groupBy("skey", "cls").agg(F.sum("n").alias("n"))
    past = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cls = cls.select("skey", "cls", F.coalesce(F.sum("n").over(
        Window.partitionBy("skey").orderBy("cls").rowsBetween(*past)), zero).alias("cls_start"))
    bucket = bucket.withColumn("start", F.coalesce(F.sum("n").over(
        Window.partitionBy("skey", "cls").orderBy("bucket").rowsBetween(*past)), zero))
    targets = source_targets(rows.select("skey", "source", "size"), weights, max_times)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|offset|"), "skey")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    starts = (bucket.join(cls, ["skey", "cls"]).join(targets, "skey")
              .select("skey", "cls", "bucket", (F.col("start") + F.col("cls_start")).alias("start"),
                      "source_size", "target", "rate", offset.alias("offset")))
    place = F.row_number().over(Window.partitionBy("skey", "cls", "bucket").orderBy("h", "doc_id", "size", "text_hash"))
    placed = rows.withColumn("place", place).join(starts, ["skey", "cls", "bucket"])
    at = F.col("start") + F.col("place")
    copies = F.floor(F.col("rate") * at + F.col("offset")) - F.floor(F.col("rate") * (at - 1) + F.col("offset"))
    return (placed.withColumn("copies", F.least(copies, F.lit(max_times).cast("long")))
            .select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source",
         text_col: str = "text") -> DataFrame:
    """The mixed corpus: the columns of ``docs`` and ``copy`` (from 1), one row for each copy.  A column
    of ``docs`` that is named ``copy`` gives way to it."""
    names = docs.columns
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("llm_row"), F.col(id_col).alias("k1"),
                       F.col(source_col).alias("k2"), F.xxhash64(F.col(text_col)).alias("k3"))
    total = mixed.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    both = left.join(total, left.k1.eqNullSafe(total.doc_id) & left.k2.eqNullSafe(total.source) & (left.k3 == total.text_hash))
    once = both.withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy("k3"))).filter("nth = 1")
    copies = once.select("llm_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("llm_copy"))
    return copies.select(*[F.col("llm_row").getField(c).alias(c) for c in names if c != "copy"], F.col("llm_copy").alias("copy"))
