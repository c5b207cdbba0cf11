"""Positional semantics on unordered Spark rows: global index, seeded shuffle, samples, splits, batches.

Datasets of the source scripts are ordered lists addressed by position (``select(range(n))``,
``train[:1%]``, ``train_test_split``).  Spark rows carry no order, so every operator here takes
an explicit order key.  Positions are computed without pulling rows into one task:

* hash orders (seeded shuffles) use the leading hex digits of the md5 key as range buckets --
  buckets are balanced by construction, their row counts form a table of at most 16**k rows
  that is broadcast, and ``row_number`` runs per bucket;
* arbitrary keys use a range exchange whose partitions are tagged and reliably checkpointed,
  so partition sizes and row tags stay consistent even if executors are lost.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import idiv
from ..session import ensure_checkpoint_dir

BUCKET_HEX_DIGITS = 4           # 65,536 hash buckets: ~1.5 M rows per bucket at 1e11 rows


def hash_key(seed, id_col, *extra) -> Column:
    """md5 over ``seed|extra...|id``; same string in DuckDB: md5(seed || '|' || id)."""
    parts = [F.lit(str(seed))] + [F.col(e).cast("string") if isinstance(e, str) else e.cast("string")
                                  for e in extra] + [F.col(id_col).cast("string")]
    return F.md5(F.concat_ws("|", *parts))


def _cols(cols):
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def prefix_sum(df: DataFrame, order_cols, weight=None, group_cols=(), bucket: Column | None = None,
               name: str = "idx", small_groups: bool = True, keep_bucket: str | None = None) -> DataFrame:
    """Exclusive running sum of ``weight`` (default 1 = 0-based global index) in ``order_cols`` order.

    ``order_cols`` must be a total order (include a unique tie-breaker).  ``bucket`` (optional)
    must be monotone in that order inside each group; with it the work is one shuffle by
    bucket plus a broadcast of per-bucket totals.  Without it a range exchange is used.  With
    ``keep_bucket`` the rows keep the bucket (or range) they were brought together by, under that name.
    """
    order = _cols(order_cols)
    groups = list(group_cols)
    w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    if bucket is not None:
        tagged = df.withColumn("_kb", bucket).withColumn("_kw", w)
        totals = tagged.groupBy(*groups, "_kb").agg(F.sum("_kw").alias("_kn"))
        run = Window.partitionBy(*groups).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*groups, "_kb", F.coalesce(F.sum("_kn").over(run), F.lit(0)).alias("_ko"))
        if small_groups:
            offsets = F.broadcast(offsets)
        within = Window.partitionBy(*groups, "_kb").orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        out = (tagged.join(offsets, groups + ["_kb"], "inner")
               .withColumn(name, (F.col("_ko") + F.sum("_kw").over(within) - F.col("_kw")).cast("long")))
        if keep_bucket:
            out = out.withColumnRenamed("_kb", keep_bucket)
        return out.drop("_kb", "_kw", "_ko")
    if groups:
        raise ValueError("group_cols needs a bucket expression")
    auto = _numeric_bucket(df, order_cols)
    if auto is not None:
        bdf, bcol = auto
        return prefix_sum(bdf, order_cols, weight, (), bcol, name, small_groups, keep_bucket).drop("_kq")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    nparts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a total order over named columns is a key: only key, weight and tag are sorted and frozen, and
    # whatever else a row has is joined to its position
    names = [c for c in ([order_cols] if isinstance(order_cols, (str, Column)) else order_cols) if isinstance(c, str)]
    skeleton = len(names) == len(order) and set(names) < set(df.columns)
    source = df.withColumn("_kw", w)
    ranged = ((source.select(*names, "_kw") if skeleton else source).repartitionByRange(nparts, *order).sortWithinPartitions(*order)
              .withColumn("_kp", F.spark_partition_id())
              .withColumn("_kr", F.monotonically_increasing_id() - F.shiftleft(F.col("_kp").cast("long"), 33)))
    # reliable checkpoint: partition ids / row tags are frozen, recomputation cannot re-sample bounds
    ranged = ranged.checkpoint(eager=True)
    totals = ranged.groupBy("_kp").agg(F.sum("_kw").alias("_kn"))
    run = Window.orderBy("_kp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(totals.select("_kp", F.coalesce(F.sum("_kn").over(run), F.lit(0)).alias("_ko")))
    if weight is None:
        local = F.col("_kr")
    else:
        within = Window.partitionBy("_kp").orderBy("_kr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = F.sum("_kw").over(within) - F.col("_kw")
    out = ranged.join(offsets, "_kp").withColumn(name, (F.col("_ko") + local).cast("long"))
    if keep_bucket:
        out = out.withColumn(keep_bucket, F.col("_kp"))
    out = out.drop("_kp", "_kr", "_kw", "_ko")
    if skeleton:
        keys = {c: f"_key_{i}" for i, c in enumerate(names)}
        out = out.withColumnsRenamed(keys)
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
        out = df.join(out, reduce(lambda x, y: x & y, same)).drop(*keys.values())
    return out


ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 65_536


def _numeric_bucket(df: DataFrame, order_cols):
    """Quantile range buckets over an integral leading order key.

    Returns (df with a ``_kq`` bucket column, bucket Column) or None for other key types.
    Boundaries come from one ``approxQuantile`` pass (at most MAX_BUCKETS values on the driver);
    the JVM ``Bucketizer`` assigns buckets by binary search.  Buckets are monotone in the key
    and hold ≈ ROWS_PER_BUCKET rows whatever the key distribution (keys must be unique).
    """
    from pyspark.ml.feature import Bucketizer
    if isinstance(order_cols, (list, tuple)) and len(order_cols) > 1:
        return None        # the first column may repeat: the range exchange splits on all columns
    first = order_cols[0] if isinstance(order_cols, (list, tuple)) else order_cols
    if not isinstance(first, str) or first not in df.columns:
        return None
    if df.schema[first].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return None
    par = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = df.count()
    buckets = int(min(MAX_BUCKETS, max(8 * par, n // ROWS_PER_BUCKET)))
    keyed = df.withColumn("_kd", F.col(first).cast("double"))
    probs = [i / buckets for i in range(1, buckets)]
    qs = keyed.approxQuantile("_kd", probs, 1.0 / (4 * buckets)) if n else []
    splits = [float("-inf")] + sorted(set(q for q in qs if q is not None)) + [float("inf")]
    out = Bucketizer(splits=splits, inputCol="_kd", outputCol="_kq", handleInvalid="keep").transform(keyed)
    # null keys sort first in Spark's ascending order: give them the bucket before all others
    return out.drop("_kd"), F.when(F.col(first).isNull(), F.lit(-1.0)).otherwise(F.col("_kq"))


def global_index(df: DataFrame, order_cols, group_cols=(), bucket: Column | None = None,
                 name: str = "idx") -> DataFrame:
    """0-based position of each row in ``order_cols`` order (per group if ``group_cols``)."""
    return prefix_sum(df, order_cols, None, group_cols, bucket, name)


def hash_bucket(hash_col: str | Column, digits: int = BUCKET_HEX_DIGITS) -> Column:
    c = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    return F.substring(c, 1, digits)


def bucket_totals(df: DataFrame, bucket: Column) -> list:
    """Sorted (bucket, rows) pairs: one aggregate, at most #buckets rows on the driver."""
    rows = df.select(bucket.alias("_kb")).groupBy("_kb").agg(F.count("*").alias("n")).collect()
    return sorted((r["_kb"], r["n"]) for r in rows if r["_kb"] is not None)


def first_n_predicate(df: DataFrame, order_cols, n: int, bucket: Column, totals: list | None = None) -> Column:
    """Boolean column: is the row among the first ``n`` in ``order_cols`` order?

    One aggregate gives the row count per bucket (a table of at most #buckets rows, read by
    the driver); the bucket holding the n-th row is the only one whose rows are ranked, and
    only its n-th key is fetched.  The result is a plain predicate, so a split or a large head
    costs one extra scan instead of a shuffle of every row.  ``bucket`` must be monotone in
    the order and ``order_cols`` a total order.
    """
    order = _cols(order_cols)
    if n <= 0:
        return F.lit(False)
    tagged = df.withColumn("_kb", bucket)
    totals = bucket_totals(df, bucket) if totals is None else totals
    seen = 0
    for b, c in totals:
        if seen + c >= n:
            k = n - seen                       # the k-th row (1-based) of bucket b is the last one in
            names = [f"_ko{i}" for i in range(len(order))]
            row = (tagged.where(F.col("_kb") == F.lit(b)).select(*[c_.alias(nm) for c_, nm in zip(order, names)])
                   .orderBy(*names).offset(k - 1).limit(1).first())
            key = F.struct(*[c_.alias(nm) for c_, nm in zip(order, names)])
            lim = F.struct(*[F.lit(row[nm]).alias(nm) for nm in names])
            return (bucket < F.lit(b)) | ((bucket == F.lit(b)) & (key <= lim))
        seen += c
    return F.lit(True)


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, name: str = "idx",
                   key_name: str = "shuffle_key") -> DataFrame:
    """Deterministic permutation: order by (md5(seed|id), id); adds the key and the position."""
    keyed = df.withColumn(key_name, hash_key(seed, id_col))
    return global_index(keyed, [key_name, id_col], bucket=hash_bucket(key_name), name=name)


def _take_first(df: DataFrame, order_cols, n: int, bucket=None, method: str = "take") -> DataFrame:
    """First ``n`` rows in order.  ``method='take'``: an ordered limit, lazy, for an ``n`` whose rows
    one task can hold; ``method='threshold'``: a bucket-threshold predicate found by two small
    jobs, for an ``n`` of any size (no shuffle of the rows).  Both give the same rows."""
    if method == "take":
        return df.orderBy(*_cols(order_cols)).limit(n)
    if method != "threshold":
        raise ValueError(f"unknown method {method!r}")
    if bucket is not None:
        return df.where(first_n_predicate(df, order_cols, n, bucket))
    auto = _numeric_bucket(df, order_cols)
    if auto is None:
        indexed = global_index(df, order_cols, name="_kidx")
        return indexed.where(F.col("_kidx") < n).drop("_kidx")
    bdf, bcol = auto
    return bdf.where(first_n_predicate(bdf, order_cols, n, bcol)).drop("_kq")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42, method: str = "take") -> DataFrame:
    """Exact-n sample: seeded shuffle first, then the head (``shuffle(seed).select(range(n))``)."""
    keyed = df.withColumn("shuffle_key", hash_key(seed, id_col))
    return _take_first(keyed, ["shuffle_key", id_col], n, bucket=hash_bucket("shuffle_key"), method=method)


def head_then_shuffle(df: DataFrame, order_cols, id_col: str, n: int | None, seed: int = 42,
                      name: str = "idx", method: str = "take") -> DataFrame:
    """First n rows in source order, then shuffled; falsy n skips the head."""
    head = _take_first(df, order_cols, n, method=method) if n else df
    return seeded_shuffle(head, id_col, seed, name=name)


def bounded_head(df: DataFrame, order_cols, n: int, method: str = "take") -> DataFrame:
    """First min(n, len) rows."""
    return _take_first(df, order_cols, n, method=method)


def train_test_split(df: DataFrame, id_col: str, test_size: float | int | None, seed: int = 42,
                     split_col: str = "split") -> DataFrame:
    """Exact-size seeded split: the first ceil(p*n) rows of the seeded permutation are 'test'.

    A falsy ``test_size`` keeps every row in 'train'.  Unlike ``randomSplit`` the sizes are exact
    and independent of partitioning.
    """
    if not test_size:
        return df.withColumn(split_col, F.lit("train"))
    keyed = df.withColumn("_kh", hash_key(seed, id_col))
    totals = bucket_totals(keyed, hash_bucket("_kh"))          # also gives n: no separate count
    n = sum(c for _, c in totals)
    n_test = int(test_size) if isinstance(test_size, int) and test_size >= 1 else math.ceil(test_size * n)
    is_test = first_n_predicate(keyed, ["_kh", id_col], n_test, hash_bucket("_kh"), totals)
    return keyed.withColumn(split_col, F.when(is_test, "test").otherwise("train")).drop("_kh")


def epoch_batches(df: DataFrame, id_col: str, epochs: int, batch_size: int, grad_accum: int,
                  seed: int = 42) -> DataFrame:
    """Per epoch: a fresh seeded order, then batch id = pos div batch and step = pos div (batch*accum)."""
    spark = df.sparkSession
    ep = F.broadcast(spark.range(epochs).withColumnRenamed("id", "epoch"))
    keyed = df.crossJoin(ep).withColumn("_kh", hash_key(seed, id_col, "epoch"))
    pos = global_index(keyed, ["_kh", id_col], group_cols=["epoch"], bucket=hash_bucket("_kh"), name="pos")
    return (pos.withColumn("batch_id", idiv("pos", batch_size))
            .withColumn("step", idiv("pos", batch_size * grad_accum))
            .drop("_kh"))


_SLICE = re.compile(r"^\s*(\w+)\s*(?:\[\s*(-?\d+%?)?\s*:\s*(-?\d+%?)?\s*\])?\s*$")


def parse_split_spec(spec: str):
    """``train[:100]`` / ``test[:1%]`` / ``train[10:20]`` → (split name, start, stop)."""
    m = _SLICE.match(spec)
    if not m:
        raise ValueError(f"bad split spec {spec!r}")
    return m.group(1), m.group(2), m.group(3)


def _bound(tok: str | None, n: int, default: int) -> int:
    if tok is None:
        return default
    if tok.endswith("%"):
        v = round(float(tok[:-1]) * n / 100)   # nearest, half to even
    else:
        v = int(tok)
    if v < 0:
        v += n
    return max(0, min(n, v))


def split_slice(df: DataFrame, spec: str, order_cols, name: str | None = "idx") -> DataFrame:
    """Row-range slice of a split in dataset order (``train[:1%]`` etc.).  With ``name`` the
    position is added as a column (distributed index); with ``name=None`` the slice is a
    bucket-threshold filter and the rows are not shuffled."""
    _, start, stop = parse_split_spec(spec)
    n = df.count() if (start or stop) else 0
    lo, hi = _bound(start, n, 0), _bound(stop, n, n)
    if start is None and stop is None:
        return df
    auto = None if name else _numeric_bucket(df, order_cols)
    if auto is None:
        indexed = global_index(df, order_cols, name=name or "_kidx")
        out = indexed.where((F.col(name or "_kidx") >= lo) & (F.col(name or "_kidx") < hi))
        return out if name else out.drop("_kidx")
    bdf, bcol = auto
    keep = first_n_predicate(bdf, order_cols, hi, bcol) & ~first_n_predicate(bdf, order_cols, lo, bcol)
    return bdf.where(keep).drop("_kq")

