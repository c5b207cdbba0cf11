"""Quality classifier: interpolated modified Kneser-Ney language model and language quantiles.

The model reads the characters of a text as they are, but for the digits 0 to 9, which are one (UTF-16 units, so four of
them are one 64-bit number).  Its tables are DataFrames, sharded by n-gram, and grow with the text they are made of; no part of
them passes through the driver or a broadcast.

Documents are dealt into blocks by a hash of their id, texts compressed.  A block gives its different
n-grams with their counts in trusted text; summed up by n-gram they are the model's counts.  Orders
are worked out from the lowest up, each n-gram joined with the sums of its context and with its own end.
The probabilities go back to the blocks that asked for them, which score their documents whole.

A document is rejected when its perplexity is outside the quantiles that the trusted documents
of its language have (repeated filler lies below them, noise above).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import broadcast_if_small, release, written

ORDER = 4
#: The unit before a text's first (no character).
START = 0xFFFF
#: Documents of a block, and units whose n-grams are held together in a task.
BLOCK, HELD = 8192, 1 << 21
LOW, HIGH = 0.001, 0.995
SLACK = 1.08
#: Units at the language's mean that are added to every text before it is judged.
PRIOR = 128


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each unit of the texts, one text after the other, and the sizes of the texts."""
    parts = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    pad = np.full(ORDER - 1, START, "<u2").tobytes()
    flat = np.frombuffer(b"".join(x for p in parts for x in (pad, p)), "<u2").astype(np.uint64)
    size = np.array([len(p) // 2 for p in parts], np.int64)
    if not len(flat):
        return np.empty(0, np.uint64), size
    flat = np.where((flat >= 48) & (flat <= 57), np.uint64(48), flat)  # which digits a number has says nothing of a text
    code = flat[ORDER - 1:].copy()
    for i in range(1, ORDER):
        code |= flat[ORDER - 1 - i: len(flat) - i] << np.uint64(16 * i)
    real = np.ones(len(flat), bool)
    begin = np.cumsum(size + ORDER - 1) - size - (ORDER - 1)
    real[(begin[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return code[real[ORDER - 1:]], size


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids whose every label row says good quality and not toxic (null counts as not good, and as toxic)."""
    return (labels.groupBy(F.col(id_col).alias("doc_id"))
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
            .filter("q = 1 and t = 0 and doc_id is not null").select("doc_id"))


def _packed(docs: DataFrame, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``llm_block``, ``llm_key`` (the id as text) and, in place of the text, ``llm_text``, compressed."""
    keep = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in keep]
    hashed = F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.col(f"`{text_col}`"))).otherwise(F.xxhash64(F.col(f"`{id_col}`").cast("string")))
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.pmod(hashed, F.lit(blocks)).cast("int").alias("llm_block"),
                      F.col(f"`{id_col}`").cast("string").alias("llm_key"), F.col(f"`{text_col}`").cast("binary").alias("llm_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for b in batches:
            small = pa.array([None if t is None else pack(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.record_batch([*b.columns[:-1], small], names=b.schema.names)

    return src.mapInArrow(run, StructType([*fields, *src.schema.fields[-3:]]))


def _texts(table: pa.Table) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows whose texts are held together: (first row, texts)."""
    unpack = zstandard.ZstdDecompressor().decompress
    held, size, first = [], 0, 0
    for i, t in enumerate(table.column("llm_text")):
        held.append(unpack(t.as_py()).decode("utf-8", "surrogatepass") if t.is_valid else "")
        size += len(held[-1])
        if size >= HELD:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _counted():
    """applyInArrow: the different n-grams of a block, with their counts in trusted documents."""
    def run(docs: pa.Table, good: pa.Table) -> pa.Table:
        trusted = set(good.column("llm_good").to_pylist())
        mine = [k in trusted for k in docs.column("llm_key").to_pylist()] if docs.num_rows else []
        gram, count = np.empty(0, np.uint64), np.empty(0, np.int64)
        for first, texts in _texts(docs) if docs.num_rows else ():
            code, size = grams(texts)
            own = np.repeat(np.array(mine[first:first + len(texts)], bool), size)
            g = np.unique(np.concatenate([gram, code]))
            n = np.zeros(len(g), np.int64)
            n[np.searchsorted(g, gram)] = count
            some, times = np.unique(code[own], return_counts=True)
            n[np.searchsorted(g, some)] += times
            gram, count = g, n
        block = docs.column("llm_block")[0].as_py() if docs.num_rows else 0
        return pa.table({"b": pa.array(np.full(len(gram), block), pa.int32()), "g": pa.array(gram.view(np.int64)), "n": pa.array(count)})
    return run


def _discounted(n: Column) -> Column:
    """What a count gives up, by the columns d1 to d3 of its order."""
    return F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(level: DataFrame) -> DataFrame:
    """One row (d1, d2, d3): modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the counts of counts;
    where those don't give one (no count of 1 or of 2), the plain 0.5."""
    c = level.agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"c{i}") for i in range(1, 5)])
    some = (F.coalesce("c1", F.lit(0)) > 0) & (F.coalesce("c2", F.lit(0)) > 0)
    y = F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2"))

    def of(i: int) -> Column:
        d = F.when(F.col(f"c{i}") > 0, i - (i + 1) * y * F.try_divide(F.col(f"c{i + 1}"), F.col(f"c{i}"))).otherwise(0.5 * i)
        return F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), d))).otherwise(F.lit(0.5)).alias(f"d{i}")

    return c.select(of(1), of(2), of(3))


def _low(g: str, units: int) -> Column:
    """The last ``units`` units of an n-gram."""
    return F.col(g) if units >= 4 else F.col(g).bitwiseAND(F.lit((1 << 16 * units) - 1))


def probabilities(counted: DataFrame) -> DataFrame:
    """``(g, p)`` for each different n-gram of ``counted(b, g, n)``: its last unit's probability after the units before it.

    The highest order uses counts, lower orders the number of different units seen before an n-gram; each order
    is interpolated with the one below, the lowest with the uniform distribution over all units seen and one more."""
    levels = {ORDER: counted.groupBy("g").agg(F.sum("n").alias("n"))}
    for k in range(ORDER - 1, 0, -1):
        above = levels[k + 1].select(_low("g", k).alias("g"), (F.col("n") > 0).cast("long").alias("n"))
        levels[k] = above.groupBy("g").agg(F.sum("n").alias("n"))
    units = levels[1].agg((F.sum(F.when(F.col("n") > 0, 1).otherwise(0)) + 1).alias("units"))
    below = None
    for k in range(1, ORDER + 1):
        level = levels[k].crossJoin(F.broadcast(_discounts(levels[k]))).withColumn("cut", _discounted(F.col("n"))).drop("d1", "d2", "d3")
        sums = (F.sum("n").alias("total"), F.sum("cut").alias("spare"))
        if k == 1:
            level = level.crossJoin(F.broadcast(level.agg(*sums))).crossJoin(F.broadcast(units)).withColumn("lower", 1.0 / F.col("units"))
        else:
            level = level.withColumn("h", F.shiftrightunsigned("g", 16)).withColumn("s", _low("g", k - 1))
            context = level.groupBy("h").agg(*sums)
            level = level.join(context, "h").join(below.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
        p = (F.col("n") - F.col("cut") + F.col("spare") * F.col("lower")) / F.col("total")
        below = level.select("g", F.when(F.col("total") > 0, p).otherwise(F.col("lower")).alias("p"))
    return below


def _scored(names: list[str]):
    """applyInArrow: the rows of a block with their units and negative log-probabilities."""
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        good = set(known.column("llm_good").drop_null().to_pylist())
        g = known.column("g").drop_null().to_numpy().view(np.uint64)
        logp = known.column("logp").drop_null().to_numpy()
        order = np.argsort(g)
        g, logp = g[order], logp[order]
        size, nll = [], []
        for _, texts in _texts(docs) if docs.num_rows else ():
            code, n = grams(texts)
            some, at = np.unique(code, return_inverse=True)
            place = np.searchsorted(g, some)
            if len(some) and (len(g) == 0 or not (g[np.minimum(place, len(g) - 1)] == some).all()):
                raise RuntimeError("an n-gram of a block has no probability")
            total = np.concatenate([[0.0], np.cumsum(-logp[place][at])]) if len(code) else np.zeros(1)
            end = np.cumsum(n)
            size += n.tolist()
            nll += (total[end] - total[end - n]).tolist()
        trusted = pa.array([k in good for k in docs.column("llm_key").to_pylist()], pa.bool_())
        out = [docs.column(c) for c in names] + [pa.array(size, pa.int64()), pa.array(nll, pa.float64()), trusted]
        return pa.table(out, names=[*names, "llm_symbols", "llm_nll", "llm_trusted"])
    return run


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` of ``docs`` (``llm_text``: the text, compressed) with ``llm_symbols``, ``llm_nll`` (summed
    negative log-probability under the model of all trusted text), ``llm_trusted`` and ``llm_of`` (key of the language)."""
    blocks = -(-max(docs.count(), 1) // BLOCK)
    rows = _packed(docs, blocks, id_col, text_col)
    ids = trusted_ids(labels).select(F.col("doc_id").cast("string").alias("llm_good"))
    good = ids.select(F.pmod(F.xxhash64("llm_good"), F.lit(blocks)).cast("int").alias("gb"), "llm_good")
    counted = rows.groupBy("llm_block").cogroup(good.groupBy("gb")).applyInArrow(_counted(), "b int, g long, n long")
    counted = written(counted, "counted")  # read by each order and on the way back
    release(docs.sparkSession)  # the texts moved for it
    known = counted.join(probabilities(counted), "g").select("b", "g", F.log("p").alias("logp"), F.lit(None).cast("string").alias("llm_good"))
    back = known.unionByName(good.select(F.col("gb").alias("b"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("double").alias("logp"), "llm_good"))
    fields = [rows.schema[c] for c in keep]
    out = StructType([*fields, StructField("llm_symbols", LongType()), StructField("llm_nll", DoubleType()), StructField("llm_trusted", BooleanType())])
    result = rows.groupBy("llm_block").cogroup(back.groupBy("b")).applyInArrow(_scored(keep), out)
    lang = F.col(f"`{lang_col}`")
    return result.withColumn("llm_of", F.when(lang.isNull(), "-").otherwise(F.concat(F.lit("+"), lang.cast("string"))))


def judged(rows: DataFrame, low: float, high: float, slack: float, prior: int) -> DataFrame:
    """Written ``rows`` of ``scored`` with ``llm_ppl``, ``llm_score``, ``llm_low``, ``llm_high`` and ``llm_keep``, by the limits
    that the scores of the trusted documents set."""
    mine = rows.filter("llm_trusted and llm_symbols > 0").select("llm_of", "llm_symbols", "llm_nll")
    mean = (F.sum("llm_nll") / F.sum("llm_symbols")).alias("llm_mean")
    all_mean = mine.agg(mean).first()[0]
    rows = rows.withColumn("llm_ppl", F.when(F.col("llm_symbols") > 0, F.exp(F.col("llm_nll") / F.col("llm_symbols"))))
    if all_mean is None:
        none = F.lit(None).cast("double")
        return (rows.withColumn("llm_score", F.col("llm_ppl")).withColumn("llm_low", none).withColumn("llm_high", none)
                .withColumn("llm_keep", F.col("llm_ppl").isNotNull()))
    means = broadcast_if_small(written(mine.groupBy("llm_of").agg(mean), "means"))
    score = F.exp((F.col("llm_nll") + prior * F.col("llm_mean")) / (F.col("llm_symbols") + prior))
    ends = F.percentile_approx("llm_score", [low, high], 100_000).alias("llm_ends")
    own = written(mine.join(means, "llm_of").select("llm_of", "llm_mean", score.alias("llm_score")), "scores")
    limits = broadcast_if_small(written(own.groupBy("llm_of").agg(F.first("llm_mean").alias("llm_mean"), ends), "limits"))
    least, most = own.agg(ends).first()[0]
    rows = rows.join(limits, "llm_of", "left")
    score = F.exp((F.col("llm_nll") + prior * F.coalesce("llm_mean", F.lit(all_mean))) / (F.col("llm_symbols") + prior))
    rows = rows.withColumn("llm_score", F.when(F.col("llm_ppl").isNotNull(), score))
    rows = rows.withColumn("llm_low", F.coalesce(F.col("llm_ends")[0], F.lit(least)) / slack)
    rows = rows.withColumn("llm_high", F.coalesce(F.col("llm_ends")[1], F.lit(most)) * slack)
    return rows.withColumn("llm_keep", F.coalesce(F.col("llm_score").between(F.col("llm_low"), F.col("llm_high")), F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, slack: float = SLACK, prior: int = PRIOR,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, lang, n_symbols, perplexity, score, low, high, keep)``.

    ``score`` is the perplexity after adding ``prior`` units at the mean of the language's trusted
    text, so that a text of a few words isn't judged on chance.  ``keep`` is true when the score is
    within the ``low`` and ``high`` quantiles of the trusted documents of the same language, widened
    by the factor ``slack``.  A language without trusted documents (null is a language too) uses
    all trusted documents; without any trusted document every non-empty text is kept.  Null and
    empty texts have a null perplexity and are not kept.  Repeated rows are scored alike; null
    ids are never trusted.  An empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = judged(written(scored(src, labels, ["doc_id", "lang"]), "scored"), low, high, slack, prior)
    return rows.select("doc_id", "lang", F.col("llm_symbols").alias("n_symbols"), F.col("llm_ppl").alias("perplexity"),
                       F.col("llm_score").alias("score"), F.col("llm_low").alias("low"), F.col("llm_high").alias("high"),
                       F.col("llm_keep").alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, slack: float = SLACK, prior: int = PRIOR,
         id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns; texts travel compressed."""
    keep = [c for c in docs.columns if c != text_col]
    rows = judged(written(scored(docs, labels, [*keep, "llm_text"], id_col, text_col, lang_col), "scored"), low, high, slack, prior)
    rows = rows.filter("llm_keep").select(*[F.col("llm_text" if c == text_col else f"`{c}`").alias(c) for c in docs.columns])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                text = pa.array([None if t is None else unpack(t) for t in b.column(at).to_pylist()], pa.binary()).view(pa.string())
                yield pa.record_batch([text if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return rows.mapInArrow(run, docs.schema)
