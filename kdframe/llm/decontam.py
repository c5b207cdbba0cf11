"""Benchmark decontamination: which documents hold (nearly) all of a test item.

Containment of an item in a document is the share of the item's distinct word shingles that the
document has.  A whole-document MinHash cannot see a short item in a long text, as the union
dwarfs the item; so the sketch is kept on the item's side.  Items are partitioned by the size
of their shingle set, and each partition fixes how many min-hash shingles an item needs as its
signature: with a containment of ``t`` at most ``floor((1 - t) * size)`` of an item's shingles
may be missing, so of the ``floor((1 - t) * upper) + 1`` smallest hashes (``upper``: largest size
of the partition) at least one must occur.  No document at or above the threshold is lost,
however long it is.  Documents probe their shingle hashes against the signatures in one pass
without a shuffle, and each candidate is verified on the words of its shingles.

Items are read in blocks of bounded size; each block is broadcast and the documents are passed
over once a block, so any number of items works in the same memory.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

SHINGLE = 5
THRESHOLD = 0.8
#: Characters of item text in one broadcast block.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores, so case and punctuation don't hide a copy."""
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str], n: int) -> list[bytes]:
    part = [w.encode("utf-8", "surrogatepass") for w in words]
    return list(map(b" ".join, zip(*(part[i:] for i in range(n)))))


def signature_size(size: int, threshold: float) -> int:
    """Min-hashes kept for an item of ``size`` distinct shingles: what the upper end of its size
    partition (powers of two) needs."""
    upper = 1 << max(0, (size - 1).bit_length())
    return min(size, int(np.floor((1 - threshold) * upper + 1e-9)) + 1)


class ItemIndex:
    """One block of items: shingle sets by width, and signature hash -> items."""

    def __init__(self, items: list[tuple], shingle: int, threshold: float):
        self.threshold = threshold
        self.sets: list[tuple] = []
        by_width: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            width = min(shingle, len(words))
            if not width:
                continue
            shingles = set(grams(words, width))
            order = sorted(shingles, key=xxhash.xxh64_intdigest)
            for g in order[:signature_size(len(order), threshold)]:
                by_width[width][xxhash.xxh64_intdigest(g)].append(len(self.sets))
            self.sets.append((item_id, width, shingles))
        self.signatures = {w: (np.sort(np.fromiter(h, np.uint64, len(h))), dict(h)) for w, h in by_width.items()}

    def matches(self, text: str | None) -> list[tuple]:
        """``(item_id, containment, shared, size)`` of the items at or above the threshold in the text."""
        words, found = words_of(text), []
        for width, (keys, items) in self.signatures.items():
            own = grams(words, width)
            if not own:
                continue
            h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
            at = np.searchsorted(keys, h)
            hit = h[keys[np.minimum(at, len(keys) - 1)] == h]
            if not len(hit):
                continue
            have = set(own)
            for i in sorted({i for k in hit.tolist() for i in items[k]}):
                item_id, _, shingles = self.sets[i]
                shared = len(shingles & have)
                if shared >= self.threshold * len(shingles) - 1e-9:
                    found.append((item_id, shared / len(shingles), shared, len(shingles)))
        return found


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Item texts in blocks of at most BLOCK_CHARS characters (one item at least)."""
    block, chars = [], 0
    for r in items.toLocalIterator():
        size = len(r["text"] or "")
        if block and chars + size > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += size
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, containment, shared, item_shingles)`` for each document row and item with
    containment at or above ``threshold``.

    Items of fewer words than ``shingle`` are one shingle of all their words; items without a
    word, and null or empty texts on either side, match nothing.  Equal item rows each give a
    row, as do equal documents.  Null ids are returned as null.  An empty table on either side
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    test = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    schema = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_col].dataType.simpleString()}, "
              "containment double, shared int, item_shingles int")

    fields = to_arrow_schema(_parse_datatype_string(schema))
    names, kinds = fields.names, fields.types

    def probe(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, shingle, threshold)
            for b in batches:
                found = [(i.as_py(), *m) for i, t in zip(b.column(0), b.column(1)) for m in index.matches(t.as_py())]
                cols = list(zip(*found)) or [[]] * len(kinds)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        return src.mapInArrow(run, schema)

    found = None
    for block in _item_blocks(test):
        part = probe(block)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item at or above ``threshold``, with their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    test = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))

    def without(rows: DataFrame, block: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, shingle, threshold)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t.as_py()) for t in b.column(at)], pa.bool_()))
        return rows.mapInArrow(run, docs.schema)

    for block in _item_blocks(test):
        docs = without(docs, block)
    return docs
