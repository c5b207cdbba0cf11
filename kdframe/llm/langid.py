"""Language identification of whole texts with spans of mixed language.

A word (a run of letters) gets a score for each language: the sum of the log-probabilities of
its letter trigrams, boundaries included.  The script of the word narrows the languages first:
only those that use the script in the training text are candidates.  Viterbi over the words of
a text, with a penalty for each change of language, labels the spans; the language with most
letters is the answer and its share of the letters the score.

Trigrams are hashed into a fixed number of buckets, so the model has ``BUCKETS`` numbers for each
language however much text it has learned from; counts are taken over all training text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Log-probability lost at a change of language.
SWITCH = 20.0
#: Share of a language's letters that a script needs to make the language a candidate.
SCRIPT_SHARE = 0.01
SMOOTH = 0.1
#: Letters scored at once; bounds the memory for texts of any length.
CHUNK = 1 << 20
LETTER_TABLE = 0x3000
#: First code points of Unicode script areas, each up to the next one.
SCRIPTS = [
    (0x0000, "latin"), (0x0250, "ipa"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})


class Letters:
    """Code-point tables, built once a task: which are letters, their lower case, their script."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(LETTER_TABLE)] + [False])
        self.lower = np.array([ord(chr(c).lower()[0]) for c in range(LETTER_TABLE)], dtype=np.uint32)
        self.first = np.array([a for a, _ in SCRIPTS], dtype=np.uint32)
        self.script = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
        self.other = SCRIPT_NAMES.index("other")

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(at, word_start, script, bucket)``: positions of the letters in the text, where each word
        begins among them, the script of each word, and the trigram bucket of each letter."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = np.minimum(cp, LETTER_TABLE)
        is_letter = self.letter[low]
        far = cp >= LETTER_TABLE
        if far.any():
            kind = self.script[np.searchsorted(self.first, cp, side="right") - 1]
            is_letter |= far & (kind != self.other)
            odd = np.flatnonzero(far & (kind == self.other))
            is_letter[odd] = [chr(c).isalpha() for c in cp[odd].tolist()]
        at = np.flatnonzero(is_letter)
        if not len(at):
            return at, at, at, at
        folded = np.where(is_letter, np.where(far, cp, self.lower[np.minimum(cp, LETTER_TABLE - 1)]), 0).astype(np.uint64)
        edge = np.zeros(1, np.uint64)
        before, after = np.concatenate([edge, folded[:-1]])[at], np.concatenate([folded[1:], edge])[at]
        mixed = before * np.uint64(0x9E3779B97F4A7C15) + folded[at] * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(31)
        bucket = ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        script = self.script[np.searchsorted(self.first, cp[at[start]], side="right") - 1]
        return at, start, script, bucket


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word for ``scores[word, language]`` under a penalty for each change.

    If no run of words gains more by leaving the best single language than one change costs, that
    language holds for all words and the search is not run.
    """
    best = int(scores.sum(axis=0).argmax())
    gain = (scores.max(axis=1) - scores[:, best]).sum()
    alone = np.delete(scores, best, axis=1) - scores[:, [best]]
    if not alone.size or gain <= penalty:
        return np.full(len(scores), best)
    run = np.concatenate([[0.0], np.cumsum(alone.max(axis=1))])
    if (run - np.minimum.accumulate(run)).max() <= penalty:
        return np.full(len(scores), best)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        lead = value.index(top)
        top -= penalty
        back.append([lead if top > v else i for i, v in enumerate(value)])
        value = [(top if top > v else v) + s for v, s in zip(value, row)]
    at = value.index(max(value))
    path = [at]
    for b in reversed(back):
        at = b[at]
        path.append(at)
    return np.array(path[::-1])


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text is divisible by 5 (a null id counts as held out)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Model:
    """Languages, trigram log-probabilities ``[bucket, language]`` and candidates ``[script, language]``."""

    def __init__(self, langs: list[str], logp: np.ndarray, may: np.ndarray):
        self.langs, self.logp, self.may = langs, logp, may

    @classmethod
    def from_counts(cls, langs: list[str], grams: np.ndarray, scripts: np.ndarray) -> Model:
        total = grams.sum(axis=1, keepdims=True)
        logp = np.log((grams + SMOOTH) / (total + SMOOTH * BUCKETS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        may = (share >= SCRIPT_SHARE).T
        return cls(langs, logp, np.where(may.any(axis=1, keepdims=True), may, True))

    def word_scores(self, start: np.ndarray, script: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.empty((len(start), len(self.langs)))
        edge = np.append(start, len(bucket))
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + CHUNK, side="right")) - 1)
            out[a:b] = np.add.reduceat(self.logp[bucket[edge[a]:edge[b]]], start[a:b] - edge[a], axis=0, dtype=np.float64)
            a = b
        return np.where(self.may[script], out, -1e6)

    def spans(self, letters: Letters, text: str | None, penalty: float) -> tuple[list[dict], str, float]:
        """Spans ``(lang, start, end)`` in characters, the language with most letters, its share."""
        at, start, script, bucket = letters.words(text or "")
        if not len(at) or not self.langs:
            return [], "und", 0.0
        path = viterbi(self.word_scores(start, script, bucket), penalty)
        size = np.diff(np.append(start, len(at)))
        total = np.bincount(path, weights=size, minlength=len(self.langs))
        first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        last = np.append(first[1:], len(path)) - 1
        ends = np.append(start[1:], len(at)) - 1
        spans = [{"lang": self.langs[path[f]], "start": int(at[start[f]]), "end": int(at[ends[e]]) + 1} for f, e in zip(first, last)]
        return spans, self.langs[int(total.argmax())], float(total.max() / total.sum())


def fit(texts: DataFrame) -> Model:
    """Model of all rows of ``texts(text, lang)``; both must be non-null."""
    langs = sorted(r["lang"] for r in texts.select("lang").distinct().collect())  # one row a language
    place = {n: i for i, n in enumerate(langs)}
    width = BUCKETS + len(SCRIPT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(), np.zeros((len(place), width), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                _, start, script, bucket = letters.words(text.as_py())
                row = total[place[lang.as_py()]]
                if len(bucket) < BUCKETS:
                    np.add.at(row, bucket, 1)
                else:
                    row[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                size = np.diff(np.append(start, len(bucket)))
                row[BUCKETS:] += np.bincount(script, weights=size, minlength=width - BUCKETS).astype(np.int64)
        flat = total.reshape(-1)
        seen = np.flatnonzero(flat)
        for at in range(0, len(seen), 1 << 16):
            part = seen[at:at + (1 << 16)]
            yield pa.record_batch([pa.array(part), pa.array(flat[part])], names=["slot", "n"])

    table = np.zeros(len(langs) * width, np.int64)
    if langs:
        rows = texts.select("text", "lang").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        table[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    table = table.reshape(len(langs), width)
    return Model.from_counts(langs, table[:, :BUCKETS], table[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` for each row of ``docs``, from the text alone.

    ``lang_pred`` is ``und``, with score 0 and no spans, if the text is null or has no letter (or the
    model has no language).  Ties go to the language first in code-point order.  Repeated rows
    get equal results; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.may))  # BUCKETS numbers a language
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = Letters(), Model(*sent.value)
        for b in batches:
            found = [m.spans(letters, t.as_py(), penalty) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()),
                                   pa.array([f[0] for f in found], span)], names=["doc_id", "lang_pred", "score", "spans"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out and have a language, then identify all:
    ``(doc_id, held_out, lang_pred, score, spans)``."""
    train = docs.filter(~held_out(F.col("doc_id"))).filter("text is not null and lang is not null").select("text", "lang")
    return identify(docs, fit(train)).withColumn("held_out", held_out(F.col("doc_id")))
