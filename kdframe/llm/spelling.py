"""Spelling variants: words one inserted, deleted or replaced letter apart, and the form each stands for.

Two words at one error agree in the first half of the one or in its second half.  Each word is
filed under the halves that a word one letter shorter, equally long or one longer would have, so shards
of a hash of the half hold all words a query of the shard may be near.  A shard delimits its words, writes
them one after the other and builds a bidirectional FM-index: suffix-rank intervals of the text
and of its reverse are kept in step, so a pattern grows to either side.  A query matches its half and
the border before it to the left, exactly, then grows to the right over the other half and the
border after it with one error.  For the second half words and queries are spelt backwards.

A half that more than ``GROUP`` words share is filed in several shards, which its queries all visit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, RAREST = 5, 3
#: Letters that a shard holds on average, words of one half in one shard, queries searched at a time.
SHARD_LETTERS, GROUP, AT_ONCE = 150_000, 15_000, 4096
#: Words one worker counts before it hands its counts on.
HELD = 400_000
BLOCK = 64


def lower_ascii(word: str) -> str:
    return word.lower() if word.isascii() else word.encode().lower().decode()


def word_counts(docs: DataFrame, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``(word, n)``: maximal runs of Latin letters of whole texts, A-Z lower-cased, that have at least
    ``shortest`` letters and ``rarest`` occurrences.

    With ``damage``, a run loses letter h % length where damage divides h = crc32(``<doc_id>:<run>``).
    A null text has no runs; a null id is written as nothing; repeated rows count each time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{key.as_py() or ''}:".encode())
                own: dict[str, int] = defaultdict(int)
                for w, n in Counter(RUN.findall(text)).items():
                    if len(w) >= shortest:
                        own[lower_ascii(w)] += n
                for w, n in own.items():
                    if damage and not (h := zlib.crc32(w.encode(), seed)) % damage:
                        w = w[: h % len(w)] + w[h % len(w) + 1:]
                        if len(w) < shortest:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held.clear()
        if held:
            yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    src = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("t"))
    counts = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= rarest)


class Ranks:
    """Counts of letters before a position of a Burrows-Wheeler transform, by blocks of ``BLOCK``."""

    def __init__(self, text: np.ndarray, letters: int):
        n, rank, k = len(text), np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while rank.max() < n - 1:  # order of all rotations by doubling; delimited different words make them differ
            rank = np.unique(rank * (n + 1) + np.roll(rank, -k), return_inverse=True)[1].astype(np.int64)
            k *= 2
        self.suffix = np.argsort(rank)
        self.n, self.letters = n, letters
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))]).astype(np.int64)
        blocks = n // BLOCK + 1
        bwt = np.full(blocks * BLOCK, letters, np.int64)  # beyond the end: no letter
        bwt[:n] = text[self.suffix - 1]
        self.blocks = bwt.reshape(blocks, BLOCK)
        per = np.bincount(np.repeat(np.arange(blocks), BLOCK) * (letters + 1) + bwt, minlength=blocks * (letters + 1)).reshape(blocks, letters + 1)
        before = np.cumsum(per, axis=0) - per
        self.lower = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(before, axis=1)], axis=1)  # letters below c before a block

    def at(self, c: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters below ``c`` and letters ``c`` before ``pos``."""
        block, inside = self.blocks[pos // BLOCK], np.arange(BLOCK) < (pos % BLOCK)[:, None]
        row, c1 = self.lower[pos // BLOCK], c[:, None]
        below = np.take_along_axis(row, c1, 1)[:, 0]
        same = np.take_along_axis(row, c1 + 1, 1)[:, 0] - below
        return below + ((block < c1) & inside).sum(1), same + ((block == c1) & inside).sum(1)

    def all(self, pos: np.ndarray) -> np.ndarray:
        """Of each letter, how many come before ``pos``."""
        block, inside = self.blocks[pos // BLOCK], np.arange(BLOCK) < (pos % BLOCK)[:, None]
        code = (np.arange(len(pos)) * (self.letters + 1))[:, None] + block
        part = np.bincount(code[inside], minlength=len(pos) * (self.letters + 1)).reshape(len(pos), -1)
        return (np.diff(self.lower[pos // BLOCK], axis=1) + part)[:, : self.letters]

    def grow(self, own: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one more letter ``c``: in this text's order, in the other's, and their size."""
        low, first = self.at(c, own)
        high, last = self.at(c, own + size)
        return self.less[c] + first, other + high - low, last - first


class Index:
    """Bidirectional FM-index of different words; letter 0 is the border before each word."""

    def __init__(self, words: list[str]):
        points = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words]
        self.points = np.unique(np.concatenate(points))
        self.letters = len(self.points) + 1
        self.begin = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        text = np.concatenate([np.concatenate([[0], self.codes(p)]) for p in points])
        self.forward, self.backward = Ranks(text, self.letters), Ranks(text[::-1], self.letters)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Letters of code points; one the index does not have is the number after its last."""
        at = np.searchsorted(self.points, points)
        return np.where(np.append(self.points, 0)[at] == points, at + 1, self.letters) if len(points) else np.zeros(0, np.int64)

    def near(self, queries: list[str], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers at exactly one error behind the query's first ``halves`` letters."""
        flat = self.codes(np.frombuffer("".join(queries).encode("utf-32-le"), "<u4"))
        size, half = np.array([len(q) for q in queries]), np.array(halves)
        begin = np.cumsum(size) - size
        codes = np.concatenate([flat, [0]])

        def letter(q: np.ndarray, i: np.ndarray) -> np.ndarray:
            """Letter i of query q; the border stands at -1 and at the query's length."""
            return codes[np.where((i < 0) | (i >= size[q]), len(flat), begin[q] + i)]

        n = self.forward.n
        q = np.arange(len(queries))
        f, b, s, i = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), n), half - 1
        ready = []
        while len(q):  # the half and the border before it, to the left
            c = letter(q, i)
            known = c < self.letters
            q, f, b, s, i, c = (x[known] for x in (q, f, b, s, i, c))
            f, b, s = self.forward.grow(f, b, s, c)
            done = (i < 0) & (s > 0)
            ready.append((q[done], f[done], b[done], s[done]))
            on = (i >= 0) & (s > 0)
            q, f, b, s, i = q[on], f[on], b[on], s[on], i[on] - 1
        q, f, b, s = (np.concatenate(x) for x in zip(*ready)) if ready else (q, f, b, s)
        clean, hurt, found = (q, f, b, s, half[q]), tuple(np.zeros(0, np.int64) for _ in range(5)), []
        while len(clean[0]) or len(hurt[0]):  # the other half and the border after it, to the right
            q, f, b, s, i = hurt
            over = i > size[q]
            found.append((q[over], f[over]))
            q, f, b, s, i = (x[~over] for x in hurt)
            c = letter(q, i)
            known = c < self.letters
            q, f, b, s, i, c = (x[known] for x in (q, f, b, s, i, c))
            b, f, s = self.backward.grow(b, f, s, c)
            some = s > 0
            next_hurt = [(q[some], f[some], b[some], s[some], i[some] + 1)]
            q, f, b, s, i = clean
            if len(q):
                c = letter(q, i)
                first = self.backward.all(b)
                size_of = self.backward.all(b + s) - first
                lower = np.cumsum(size_of, axis=1) - size_of
                row, new = np.nonzero(size_of)
                grown = (q[row], f[row] + lower[row, new], self.backward.less[new] + first[row, new], size_of[row, new], i[row])
                same, inside, more = new == c[row], grown[4] < size[grown[0]], new > 0
                clean = tuple(x[same & inside] for x in (*grown[:4], grown[4] + 1))
                swap, put = ~same & more & inside, ~same & more
                next_hurt.append(tuple(x[swap] for x in (*grown[:4], grown[4] + 1)))  # a letter replaced
                next_hurt.append(tuple(x[put] for x in grown))  # a letter put in, behind equal ones
                cut = (i < size[q]) & (letter(q, i + 1) != c)  # a letter left out, the last of equal ones
                next_hurt.append((q[cut], f[cut], b[cut], s[cut], i[cut] + 1))
            hurt = tuple(np.concatenate(x) for x in zip(*next_hurt))
        q, f = (np.concatenate(x) for x in zip(*found)) if found else (q, f)
        word = np.searchsorted(self.begin, self.forward.suffix[f], side="right") - 1
        pairs = np.unique(q * len(self.begin) + word)
        return pairs // len(self.begin), pairs % len(self.begin)


def search(table: pa.Table) -> pa.Table:
    """One shard: rows ``(side, word, n, part, query)``; of each query its near words here: how many, the best one."""
    side = table.column("side")[0].as_py()
    known, held, ask = {}, set(), set()
    for w, n, part, query in zip(*(table.column(c).to_pylist() for c in ("word", "n", "part", "query"))):
        if query != 1:
            known[w] = n
            held.add((w, part))
        if query:
            ask.add(w)
    names = ["word", "n_near", "best_n", "best"]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string()))))
    words, queries = sorted(known), sorted(ask)  # code-point order
    out = []
    if words and queries:
        spelt = words if side == 0 else [w[::-1] for w in words]
        index, n = Index(spelt), np.array([known[w] for w in words])
        for at in range(0, len(queries), AT_ONCE):
            part = queries[at:at + AT_ONCE]
            size = [len(x) // 2 if side == 0 else len(x) - len(x) // 2 for x in part]
            q, w = index.near(part if side == 0 else [x[::-1] for x in part], size)
            # a shard answers for the words it holds under the query's half; words that begin with the first half are side 0's
            ok = [(words[b], size[a]) in held and not (side and words[b].startswith(part[a][: len(part[a]) // 2]))
                  for a, b in zip(q.tolist(), w.tolist())]
            q, w = q[np.array(ok, bool)], w[np.array(ok, bool)]
            order = np.lexsort((w, -n[w], q))
            q, w = q[order], w[order]
            one, first, count = np.unique(q, return_index=True, return_counts=True)
            best = w[first]
            out.append(pa.table([pa.array([part[a] for a in one], pa.string()), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()),
                                 pa.array([words[b] for b in best], pa.string())], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def filed(words: DataFrame, shards: int) -> DataFrame:
    """``(side, shard, word, n, part, query)``: words under their halves, of ``part`` letters; query 0 to be found, 1 to ask, 2 both."""
    size = F.length("word")
    parts = []
    for side, half in ((0, lambda m: F.floor(m / 2)), (1, lambda m: m - F.floor(m / 2))):
        own = half(size).cast("int")
        lengths = F.array_distinct(F.array(*[half(size + d).cast("int") for d in (-1, 0, 1)]))
        rows = words.select("word", "n", own.alias("own"), F.explode(lengths).alias("part"))
        key = F.substring("word", F.lit(1), F.col("part")) if side == 0 else F.substring("word", -F.col("part"), F.col("part"))
        parts.append(rows.select(F.lit(side).alias("side"), key.alias("half"), "part", "word", "n", (F.col("part") == F.col("own")).alias("asks")))
    rows = parts[0].unionByName(parts[1])
    wide = rows.groupBy("side", "half").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > GROUP)
    wide = broadcast_if_small(written(wide.withColumn("split", F.ceil(F.col("rows") / GROUP).cast("int")).drop("rows"), "wide"), 1_000_000)
    rows = rows.join(wide, ["side", "half"], "left").withColumn("split", F.coalesce("split", F.lit(1)))
    home = F.pmod(F.xxhash64("word"), F.col("split")).cast("int")
    visits = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("split") - 1)).otherwise(F.array(home))
    rows = rows.withColumn("home", home).withColumn("salt", F.explode(visits))
    kind = F.when(~F.col("asks"), 0).when(F.col("salt") == F.col("home"), 2).otherwise(1)
    shard = F.pmod(F.xxhash64("side", "half", "salt"), F.lit(shards)).cast("int")
    return rows.select("side", shard.alias("shard"), "word", "n", "part", kind.alias("query"))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)`` of the rows of ``words(word, n)`` that have a word at one error:
    how many, and the most frequent of them (ties: smallest in code-point order).

    ``words`` is read more than once and should be a written table; its words are different, not
    null and have two letters at least.
    """
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    shards = max(1, 2 * letters // SHARD_LETTERS)
    rows = filed(words, shards).repartition(2 * shards, "side", "shard")
    found = rows.groupBy("side", "shard").applyInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last form from each word of ``forms(word, form)`` on.

    Each round doubles the steps taken; as every form is at least twice as frequent as its
    word, chains are short and so are the rounds."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(at.join(broadcast_if_small(on, 100_000), "root", "left"), "roots")
        at = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.filter("further is not null").isEmpty():
            return at


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``words(word, n)``.

    ``form`` is the most frequent word at one error if it is at least ``times`` as frequent, else null;
    ``root`` follows forms to the last.  No words give no rows.
    """
    words = written(words, "words")
    form = (F.col("best_n") >= times * F.col("n")) & F.col("best").isNotNull()
    known = written(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")), "forms")
    end = roots(known.filter("form is not null"))
    return known.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
