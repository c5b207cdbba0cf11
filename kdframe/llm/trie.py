"""Prefix trie of conversations: one row for each distinct sequence of first turns.

A turn is known by the MD5 of its role and text and carries its word count; a conversation is the
byte string of its turns, twenty bytes a turn, so texts never move.  Equal conversations are
grouped first, by blocks of conversation ids, so a conversation that a third of all repeat
is one row a block.  The rest is dealt by ranges of the byte strings: a subtree then lies in one shard, but for
the nodes on a shard's first and last path.

A shard enumerates its distinct prefix digests, gives each a slot by a minimal perfect hash, checks
every digest, parent and turn against what its slot holds, scatters counts into flat numpy
arrays and adds them up through the array of parent slots, deepest first.  Nodes on a shard's
borders, at most two paths a shard, leave their sums open; a table of the same kind adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, written
from .mixing import word_count

#: Bytes of a turn in a path: an MD5 and a word count.
TURN = 20
#: Conversation ids of one block, which bounds the list of ids that a row holds.
BLOCK = 4096
LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, seq)``: the turns of each conversation in order, each as forty hex digits.

    Turns are ordered by ``turn`` (null first); ties by role, then by the MD5 of the turn, so repeated
    rows are turns of their own and side by side.  A null role or text is empty.  Rows without a
    conv_id belong to no conversation and are left out; other columns are ignored.  A
    conversation is one row: 40 bytes a turn of one conversation must fit a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), F.concat(mark, F.lpad(F.hex(word_count(text)), 8, "0")).alias("mark")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["mark"]).alias("seq"))


def with_heads(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every instead of its own
    first h; h = crc32(c) % most.  A head that is absent or shorter gives what it has."""
    lead = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = F.first(F.when(F.col("conv_id") == F.col("lead"), F.slice("seq", 1, most - 1)), ignorenulls=True)
    both = seqs.withColumn("lead", lead).withColumn("head", first.over(Window.partitionBy("lead"))).withColumn("h", h)
    own = F.slice("seq", F.col("h") + 1, F.size("seq"))
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(head, own).alias("seq"))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit digests, given as two uint64 lanes.

    Level by level a digest takes the cell its hash names if no other wants it; those left go on to
    the next level.  A slot is the number of taken cells before its own.  Whatever is not among
    the digests gets some slot as well, so callers compare what a slot holds.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, self.n, done = [], len(a), 0
        while len(a):
            cells = max(2 * len(a), 8)
            at = self._cell(a, b, len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            self.levels.append((cells, alone, done + np.cumsum(alone) - alone))
            done += int(alone.sum())
            rest = ~alone[at]
            a, b = a[rest], b[rest]

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
        x = (a + np.uint64(2 * level + 1) * b) * LANES[0]
        return ((x ^ (x >> np.uint64(31))) % np.uint64(cells)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(a), np.int64), np.arange(len(a))
        for level, (cells, alone, before) in enumerate(self.levels):
            at = self._cell(a[left], b[left], level, cells)
            hit = alone[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


class Nodes:
    """Flat arrays of the nodes of a shard, one entry a slot, from all places where a node is met.

    ``up`` is the place of a place's parent, -1 at the root; ``turn`` has what must agree where two
    places share a digest.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray, turn: np.ndarray, up: np.ndarray):
        order = np.lexsort((a, b))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        one = order[new]
        mph = PerfectHash(a[one], b[one])
        self.n, self.slot = mph.n, mph.slots(a, b)
        parent = np.where(up >= 0, self.slot[up], -1)
        held = np.empty(self.n, np.int64)  # of each slot, a place that has it
        held[self.slot] = np.arange(len(a))
        at = held[self.slot]
        same = (a == a[at]) & (b == b[at]) & (depth == depth[at]) & (parent == parent[at]) & (turn == turn[at]).all(axis=1)
        if not same.all():
            raise RuntimeError("two prefixes share a digest")
        self.held, self.depth, self.parent = held, depth[held], parent[held]

    def summed(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.slot, values)
        return out

    def least(self, values: np.ndarray) -> np.ndarray:
        out = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(out, self.slot, values)
        return out

    def children(self, of: np.ndarray) -> np.ndarray:
        """How many of the nodes ``of`` each node is the parent of."""
        up = self.parent[of]
        return np.bincount(up[up >= 0], minlength=self.n)

    def add_up(self, of: np.ndarray, *arrays: np.ndarray) -> None:
        """Adds the nodes ``of`` to their parents, deepest first, in each of ``arrays``."""
        of = of[np.argsort(self.depth[of], kind="stable")]
        depth = self.depth[of]
        ends = np.flatnonzero(np.diff(depth, prepend=-1, append=-1))
        for lo, hi in zip(ends[-2::-1], ends[:0:-1]):
            now = of[lo:hi]
            up = self.parent[now]
            now, up = now[up >= 0], up[up >= 0]
            for x in arrays:
                np.add.at(x, up, x[now])


SHARD_COLUMNS = ("a long, b long, up_a long, up_b long, open boolean, up_open boolean, conv_id long, parent_conv_id long, depth long, "
                 "words long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
BATCH = 50_000


def _rows(columns: dict[str, np.ndarray | list]) -> Iterator[pa.RecordBatch]:
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=BATCH)


def _masked(values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def digests(turn: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest lanes of every prefix of every path; path i has size[i] + 1 of them from start[i] + i on."""
    a, b = (np.zeros(len(turn) + len(size), np.uint64) for _ in range(2))
    live, d = np.arange(len(size)), 0
    while len(live := live[size[live] > d]):
        at = start[live] + live + d
        t = turn[start[live] + d]
        x = (a[at] ^ t[:, 0]) * LANES[0] + b[at]
        x ^= x >> np.uint64(29)
        y = (b[at] ^ t[:, 1]) * LANES[1] + x
        y ^= y >> np.uint64(32)
        a[at + 1], b[at + 1] = x * LANES[1] + y, y * LANES[0]
        d += 1
    return a, b


def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of paths, from rows ``(path, block, n, low, ids)`` sorted by path and block."""
    paths, count, low, sha, hasher = [], [], [], [], None
    for batch in batches:
        for path, n, first, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "low", "ids"))):
            if not paths or path != paths[-1]:
                if hasher:
                    sha.append(hasher.hexdigest())
                paths.append(path)
                count.append(0)
                low.append(first)
                hasher = hashlib.sha256(ids.encode())
            else:
                hasher.update(b"," + ids.encode())
                low[-1] = min(low[-1], first)
            count[-1] += n
    if not paths:
        return
    sha.append(hasher.hexdigest())
    size = np.array([len(p) // TURN for p in paths])
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, TURN)
    marks = np.ascontiguousarray(flat[:, :16]).view(">u8").astype(np.uint64).reshape(-1, 2)
    words = np.ascontiguousarray(flat[:, 16:]).view(">u4").astype(np.int64).ravel()
    a, b = digests(marks, start, size)
    places = size + 1
    path_of = np.repeat(np.arange(len(size)), places)
    depth = np.arange(len(a)) - np.repeat(start + np.arange(len(size)), places)
    turn = np.zeros((len(a), 3), np.uint64)
    turn[depth > 0, :2], turn[depth > 0, 2] = marks, words.astype(np.uint64)
    t = Nodes(a, b, depth, turn, np.where(depth > 0, np.arange(len(a)) - 1, -1))
    n_convs, conv = t.summed(np.array(count)[path_of]), t.least(np.array(low)[path_of])
    border = np.zeros(t.n, bool)
    border[t.slot[: places[0]]] = border[t.slot[len(a) - places[-1]:]] = True
    inner = np.flatnonzero(~border)
    own = turn[t.held, 2].astype(np.int64)
    children = t.children(inner)
    saved, leaves = np.where(border, 0, (n_convs - 1) * own), ((children == 0) & ~border).astype(np.int64)
    t.add_up(inner, saved, leaves)
    ends = np.full(t.n, None, object)
    ends[t.slot[np.cumsum(places) - 1]] = sha
    up, none = np.maximum(t.parent, 0), t.parent < 0
    x, y = a[t.held].view(np.int64), b[t.held].view(np.int64)
    yield from _rows({
        "a": x, "b": y, "up_a": _masked(x[up], none), "up_b": _masked(y[up], none), "open": border, "up_open": border[up] & ~none,
        "conv_id": conv, "parent_conv_id": _masked(conv[up], none), "depth": t.depth, "words": own, "n_convs": n_convs,
        "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(ends, pa.string())})


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what the shards left open: rows of ``SHARD_COLUMNS``, one for each shard that has the node."""
    parts = [x for x in batches if x.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    col = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in rows.column_names if not c.startswith("up_") and c != "parent_conv_id"}
    a, b = col["a"].view(np.uint64), col["b"].view(np.uint64)
    place = {k: i for i, k in enumerate(zip(col["a"].tolist(), col["b"].tolist()))}
    up = np.array([place.get(k, -1) for k in zip(rows.column("up_a").to_pylist(), rows.column("up_b").to_pylist())])
    t = Nodes(a, b, col["depth"], col["words"].reshape(-1, 1), up)
    n_convs, conv = t.summed(col["n_convs"]), t.least(col["conv_id"])
    children = t.summed(col["n_children"]) + t.children(np.arange(t.n))
    saved = t.summed(col["saved_tokens"]) + (n_convs - 1) * col["words"][t.held]
    leaves = t.summed(col["n_leaves"]) + (children == 0)
    t.add_up(np.arange(t.n), saved, leaves)
    ends = np.full(t.n, None, object)
    has = np.array([e is not None for e in col["ends_sha256"]], bool)
    ends[t.slot[has]] = col["ends_sha256"][has]
    above, none = np.maximum(t.parent, 0), t.parent < 0
    yield from _rows({
        "a": col["a"][t.held], "b": col["b"][t.held], "conv_id": conv, "parent_conv_id": _masked(conv[above], none), "depth": t.depth,
        "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(ends, pa.string())})


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``seqs(conv_id, seq)``, one row each: ``conv_id`` (the smallest
    conversation that starts with it), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    An empty sequence ends at the root.  No sequences give no rows, not even a root.
    """
    path = F.unhex(F.array_join("seq", ""))
    rows = seqs.select("conv_id", path.alias("path"), F.floor(F.col("conv_id") / BLOCK).alias("block"))
    grouped = rows.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = grouped.repartitionByRange("path").sortWithinPartitions("path", "block")
    nodes = written(dealt.mapInArrow(shard, SHARD_COLUMNS), "trie")
    names = ["conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in ["a", "b", *names])
    # two paths a shard at most, whatever the number of conversations
    border = written(nodes.filter("open").repartition(1).mapInArrow(close, kinds), "border")
    known = broadcast_if_small(border.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("known")), 1_000_000)
    inner = nodes.filter("not open").withColumns({c: F.when(F.col("up_open"), F.col(c)) for c in ("up_a", "up_b")})
    inner = inner.join(known, ["up_a", "up_b"], "left").withColumn("parent_conv_id", F.coalesce("known", "parent_conv_id"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return inner.select(names).unionByName(border.select(names)).withColumn("ends_sha256", F.coalesce("ends_sha256", none))
