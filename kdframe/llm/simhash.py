"""SimHash near-dedup: fingerprints, links at a small Hamming distance, components.

Linking works on distinct fingerprints.  A fingerprint is embedded as the bit counts of its
32 two-bit segments; the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints.  Two fingerprints at three or fewer differing bits differ in at
most one bit in one of their 32-bit halves, so for each half a grid join with unit cells finds
the pairs whose half-embeddings are at Manhattan distance 0 (same cell) or 1 (a cell and the
next cell up along one axis); every pair found is then verified exactly on all 64 bits.

A cell that many fingerprints share (a large group of near copies) is cut into blocks of a
fixed size and its block pairs are compared apart from each other; each comparison writes a
spanning forest of what it linked, never the pairs, so the output stays in proportion to the
rows however dense a cell is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

SEED = 42
SHINGLE_CHUNK = 1 << 16
#: Fingerprints compared at once in a dense cell: bounds the memory of one comparison, not the cell.
BLOCK = 1024
_ODD = 0x55555555


def fingerprint_of(text: bytes | None, k: int) -> int:
    """64-bit SimHash of one text: A-Z lower-cased, words split at ASCII white space, ``k``-word
    shingles with repeats (fewer words: the whole sequence), XXH64 seed 42, majority per bit."""
    words = text.lower().split() if text else []
    n = max(len(words) - k + 1, 1 if words else 0)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLE_CHUNK):
        part = words[at:min(n, at + SHINGLE_CHUNK) + k - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
        digest = b"".join([xxhash.xxh64_digest(g, SEED) for g in grams])
        bits = np.unpackbits(np.frombuffer(digest, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row_key, fp)`` for every row of ``docs``; ``fp`` holds the 64 bits as a signed long, and
    ``row_key`` a hash of id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "row_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                      F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    return src.mapInArrow(run, f"doc_id {kind}, row_key bigint, fp bigint")


def _half_cells(fp: F.Column, half: int) -> F.Column:
    """Array of (cell, home) for one 32-bit half: the home cell, and the next cell up along each
    axis whose two-bit segment holds fewer than two set bits."""
    bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    e = bits - F.shiftright(bits, 1).bitwiseAND(F.lit(_ODD))
    tag = F.lit(half << 32)
    ups = [F.when(F.shiftrightunsigned(e, 2 * i).bitwiseAND(F.lit(3)) < 2,
                  F.struct((e + F.lit(1 << (2 * i)) + tag).alias("cell"), F.lit(False).alias("home")))
           for i in range(16)]
    return F.array(F.struct((e + tag).alias("cell"), F.lit(True).alias("home")), *ups)


def forest(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell as a spanning forest: ``(x, root)`` for every fingerprint linked to
    another one, where at least one end of a compared pair is at home in the cell."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    near &= home[:, None] | home[None, :]
    np.fill_diagonal(near, True)
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _compare(max_bits: int):
    """mapInPandas over rows sorted by (task, fp): complete groups are compared, the last one of
    a batch waits for its rest.  A group holds two blocks at most."""
    def links(g: pd.DataFrame) -> pd.DataFrame:
        fps, home = g["fp"].to_numpy().view(np.uint64), g["home"].to_numpy()
        task = g["task"].to_numpy()
        start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        size = np.diff(np.r_[start, len(task)])
        u, v = [], []
        small = size <= 48
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, int(size[small].max(initial=1))):  # small groups: all at once, row against row + d
            a, b = np.arange(len(fps) - d), np.arange(d, len(fps))
            ok = (group[a] == group[b]) & small[group[a]] & (home[a] | home[b])
            ok &= np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
            u.append(fps[b[ok]])
            v.append(fps[a[ok]])
        for i in np.flatnonzero(~small):
            s = slice(start[i], start[i] + size[i])
            x, r = forest(fps[s], home[s], max_bits)
            u.append(x)
            v.append(r)
        if not u:
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        return pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            cut = int(np.flatnonzero(b["task"].to_numpy() != b["task"].iloc[-1]).max(initial=-1)) + 1
            if cut:
                yield links(b.iloc[:cut])
            rest = b.iloc[cut:]
        if rest is not None:
            yield links(rest)
    return run


def fingerprint_links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``(u, v)`` that connect all fingerprints of ``distinct(fp)`` at ``max_bits`` or fewer
    differing bits (spanning links of each compared group, not every pair)."""
    if max_bits > 3:
        raise ValueError("the two-half grid is complete for up to 3 differing bits")
    cells = distinct.select("fp", F.explode(F.concat(_half_cells(F.col("fp"), 0), _half_cells(F.col("fp"), 1))).alias("c"))
    cells = cells.filter("c is not null").select("fp", "c.cell", "c.home")
    w = Window.partitionBy("cell")
    cells = (cells.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("homes", F.sum(F.col("home").cast("int")).over(w))
             .filter("n > 1 and homes > 0"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda o: F.concat_ws(",", F.col("cell"), F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    tasks = (cells.withColumn("blocks", blocks).withColumn("own", own)
             .select("fp", "home", F.explode(pairs).alias("task"))
             .withColumn("task", F.xxhash64("task")))
    return (tasks.repartition("task").sortWithinPartitions("task", "fp")
            .mapInPandas(_compare(max_bits), "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, fingerprint, component_id, row_key)``.

    ``component_id`` is the smallest id among all documents reachable over links of
    ``max_bits`` or fewer differing bits.  Null, empty and white-space-only texts have
    fingerprint zero and are linked like any other.  Repeated rows share a component.  A null
    id is carried along and never becomes a component id unless the whole component has none.
    An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    f = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(f.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    rooted = (distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return f.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                                       "row_key", F.col("root").alias("component"))


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest id stays
    (of equal ids the one with the smallest row key, of equal rows one); a null id only if all are."""
    groups = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    keep = written(groups.groupBy("component").agg(first).select(F.col("first.row_key").alias("llm_key")), "kept")
    rows = docs.withColumn("llm_key", F.xxhash64(F.col(id_col), F.col(text_col))).join(keep, "llm_key", "left_semi")
    copies = groups.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if copies.limit(1).count():  # rows equal in id and text
        rank = F.row_number().over(Window.partitionBy("llm_key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
        rows = rows.withColumn("llm_nth", rank).filter("llm_nth = 1")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
