"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length into buckets of a fixed size, longest first.  A first pass over
the longest bucket gives each query a lower bound of its k-th best score.  For a query, a bucket
whose longest vector cannot reach that bound is skipped whole; in any other bucket the bound
becomes a local cosine threshold, which chooses how to prune: a high one prunes by coordinates
(a vector close in angle must be close in each of the query's largest coordinates), a low one
by length (a prefix of the bucket, sorted by length).  Products are verified in whole numbers.

Work is a set of (bucket, query block) pairs of bounded size: buckets hold at most ``BUCKET``
vectors even when thousands of vectors are equal, query blocks at most ``QUERIES`` queries.
Each pair returns k rows a query, and the final ranking is a small aggregate over those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 10
SCALE = 1024
EVERY = 100
BUCKET = 8192
QUERIES = 512
#: Local cosine threshold from which coordinates prune better than lengths.
STEEP = 0.9
FOCUS = 4
_EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v, n2)`` of the vectors that take part: components as ``floor(scale * x)``, ``n2``
    the squared length as a double.  Null vectors, and vectors with a null, NaN or infinite
    component, are left out; an empty vector has length 0."""
    x = F.col("x")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("x"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    src = src.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    v = F.transform(x, lambda c: F.floor(c * float(scale)).cast("long"))
    return src.select("vec_id", v.alias("v")).withColumn(
        "n2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if len(column) else [], dtype=np.int64).reshape(len(column), -1)


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles where every partial sum fits 53 bits, longs otherwise."""
    if q.size and m.size and float(np.abs(q).max()) * float(np.abs(m).max()) * q.shape[-1] < _EXACT:
        return (m.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64).T
    return q @ m.T


def bucket_top(q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> list[tuple]:
    """Best ``k`` of one bucket for each query, as (query, vec_id, score); rows of the bucket that
    cannot reach a query's bound are pruned before any product is formed."""
    length = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    ids, m, length = ids[order], m[order], length[order]
    unit = m / np.maximum(length, 1e-300)[:, None]
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    out, whole = [], []
    for i in range(len(q)):
        need = bound[i]
        if np.isnan(need) or need <= 0 or q_len[i] == 0:
            whole.append(i)
            continue
        cosine = need / (q_len[i] * max(length[0], 1e-300)) * (1 - 1e-9)
        if cosine > 1:
            continue
        keep = length >= need / q_len[i] * (1 - 1e-9)
        if cosine >= STEEP:
            local = np.minimum(1.0, need / (q_len[i] * np.maximum(length, 1e-300)) * (1 - 1e-9))
            unit_q = q[i] / q_len[i]
            for f in np.argsort(-np.abs(unit_q))[:FOCUS]:
                slack = np.sqrt((1 - local ** 2) * max(0.0, 1 - unit_q[f] ** 2)) + 1e-9
                keep &= np.abs(unit[:, f] - local * unit_q[f]) <= slack + (1 - local) * abs(unit_q[f])
        elif keep.all():
            whole.append(i)
            continue
        at = np.flatnonzero(keep)
        if len(at):
            out += _best(q_ids[i], ids[at], _products(q[i:i + 1], m[at])[0], need, k)
    for s in range(0, len(whole), 64):
        rows = whole[s:s + 64]
        for i, score in zip(rows, _products(q[rows], m)):
            out += _best(q_ids[i], ids, score, bound[i], k)
    return out


def _best(query: int, ids: np.ndarray, score: np.ndarray, need: float, k: int) -> list[tuple]:
    keep = ids != query
    if not np.isnan(need):
        keep &= score >= need
    ids, score = ids[keep], score[keep]
    if len(ids) > k:
        low = np.partition(score, len(score) - k)[len(score) - k]
        sure = score >= low
        ids, score = ids[sure], score[sure]
    top = np.lexsort((ids, -score))[:k]
    return [(int(query), int(ids[t]), int(score[t])) for t in top]


def _tiles(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits of every (bucket, query block) pair: ``vectors(bucket, dim, vec_id, v)`` against
    ``queries(vec_id, v, dim, block, bound)``, where a query goes only to buckets whose longest
    vector can reach its bound."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        is_q = g["is_query"].to_numpy()
        qs, vs = g[is_q], g[~is_q]
        out = []
        if len(qs) and len(vs):
            out = bucket_top(qs["vec_id"].to_numpy(np.int64), _matrix(qs["v"]), qs["bound"].to_numpy(np.float64),
                             vs["vec_id"].to_numpy(np.int64), _matrix(vs["v"]), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    buckets = vectors.groupBy("dim", "bucket").agg(F.max("n2").alias("top"))
    asked = (queries.join(buckets, "dim")
             .filter(F.col("bound").isNull() | (F.col("bound") <= 0)
                     | (F.sqrt("n2") * F.sqrt("top") >= F.col("bound") * (1 - 1e-9)))
             .select("bucket", "block", F.lit(True).alias("is_query"), "vec_id", "v", "bound"))
    pairs = asked.select("bucket", "block").distinct()
    held = vectors.join(pairs, "bucket").select("bucket", "block", F.lit(False).alias("is_query"), "vec_id", "v",
                                                F.lit(None).cast("double").alias("bound"))
    return (asked.unionByName(held).groupBy("bucket", "block")
            .applyInPandas(run, "query_id bigint, vec_id bigint, score bigint"))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query; a bucket has already cut its share to ``k``."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id is divisible by ``every``, its ``k``
    best other rows by integer inner product, ties to the smaller id (all, if fewer).

    A query never finds a row of its own id.  Rows with a null id take no part.  Repeated query
    rows are asked once; repeated candidate rows each count.  Vectors meet only vectors of the
    same dimension.  An empty table, or one without queries, gives no rows; other columns are
    ignored.
    """
    v = quantised(vectors, scale, id_col, vec_col).filter("vec_id is not null")
    v = v.withColumn("dim", F.size("v")).withColumn("len", F.floor(F.log2(F.greatest(F.col("n2"), F.lit(0.5))) * 4))
    v = written(v, "vectors")
    sizes = v.groupBy("dim", "len").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BUCKET))
    v = v.join(sizes, ["dim", "len"]).withColumn("slot", block)
    v = v.withColumn("bucket", F.concat_ws("/", "dim", "len", "slot")).drop("n")
    q = v.filter(F.col("vec_id") % every == 0).select("vec_id", "v", "n2", "dim").distinct()
    q = q.join(q.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "dim")
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / QUERIES))).drop("n")
    # first pass: the longest bucket of each dimension bounds the k-th best score from below
    first = v.groupBy("dim").agg(F.max(F.struct("len", "slot", "bucket")).alias("b")).select("dim", F.col("b.bucket").alias("bucket"))
    seen = _ranked(_tiles(v.join(first, ["dim", "bucket"]), q.withColumn("bound", F.lit(None).cast("double")), k), k)
    bounds = written(seen.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound")), "bounds")
    hits = _tiles(v, q.join(bounds, "vec_id", "left"), k)
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")
