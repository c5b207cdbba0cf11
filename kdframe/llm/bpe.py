"""Byte-pair encoding and decoding with a tokenizer file of the ``tokenizers`` library.

A word is a doubly linked list of symbols.  A priority queue holds the merges that neighbours
allow, lowest rank first and leftmost first among equals; an entry is skipped if its symbol is gone or has
another neighbour by now.  Decoding joins the strings of the ids.

Text is prepared as the file's normalizer and pre-tokenizer do.  For characters below U+0180 their rules are
a lower-casing and one pattern, which is held against the library when a file is read; words with other
characters go through the file's own normalizer and pre-tokenizer, one by one, as no rule
reaches over white space.  A Python worker keeps the ids of words and pieces it has met from task to task.  Ids are
packed as little-endian unsigned 32-bit integers, the form token files on disk have.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by_worker

#: Pieces and words whose ids one worker keeps, and the longest kept: a memory bound, not a limit of the encoding.
KEPT_PIECES, KEPT_WORDS, KEPT_LENGTH = 500_000, 100_000, 64
#: Longer texts are cut at white space into parts of about this many characters.
PART = 1 << 20
#: Bytes of results after which a batch is handed on.
HAND_ON = 8 << 20
#: Characters that str.split takes as white space and the tokenizer's \s does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile(r"[^\S\x1c-\x1f]+")


def default_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def read_file(path: str | None = None) -> str:
    with open(path or default_file(), encoding="utf-8") as f:
        return f.read()


def parts_of(text: str) -> Iterator[str]:
    """``text`` in parts of about ``PART`` characters that end in white space."""
    at = 0
    while at < len(text):
        end = min(at + PART, len(text))
        if end < len(text):
            border = SPACES.search(text, end)
            end = border.end() if border else len(text)
        yield text[at:end]
        at = end


def words_of(text: str) -> list[str]:
    """The runs of ``text`` between white space."""
    return [w for w in SPACES.split(text) if w] if SEPARATORS.search(text) else text.split()


#: Characters that the library's own normalizer and pre-tokenizer prepare.
OTHER = re.compile("[^\x00-\u017f]")


def _class(kind: str) -> str:
    """The characters below U+0180 of a general category (L or N), as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


class Encoder(dict):
    """Packed ids by piece; a piece not met before is encoded and kept."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        spec, library = json.loads(file), Tokenizer.from_str(file)
        model = spec["model"]
        options = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False,
                   "byte_fallback": False, "ignore_merges": False}
        other = {k: model.get(k) for k, v in options.items() if (model.get(k) or v) != v}
        if model["type"] != "BPE" or other or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError(f"not a plain BPE file: {model['type']} {other}")
        self.normal = library.normalizer.normalize_str if library.normalizer else str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.vocabulary, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        v = self.vocabulary
        self.merges = {v[a] << 20 | v[b]: rank << 20 | v[a + b] for rank, (a, b) in enumerate(pairs)}
        added = spec.get("added_tokens") or []
        plain = ("single_word", "lstrip", "rstrip", "normalized")
        if any(t[k] for t in added for k in plain) or any(t["content"].split() != [t["content"]] for t in added):
            raise ValueError("added tokens with options of their own")
        self.added = {t["content"]: t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        # bytes as the letters that stand for them: printable ones are their own, the others follow from U+0100 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte = {c: b for b, c in self.letter.items()}
        if any(self.pieces_of(f"a{space}b") != ["a", "b"] for space in " \n\u3000"):
            raise ValueError("words are not cut at white space")
        self.words: dict[str, bytes] = {}
        self.find = self._pattern(spec)

    def pieces_of(self, text: str) -> list[str]:
        """The library's pieces of ``text``."""
        return [bytes(map(self.byte.__getitem__, p)).decode("utf-8", "surrogatepass") for p, _ in self.cut(self.normal(text))]

    def _pattern(self, spec: dict):
        """What finds the pieces of lower-cased text below U+0180, if one pattern does as the library."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split" and s["invert"]]
        if len(split) != 1 or not split[0]:
            return None
        classes = {r"[\p{L}]": f"[{_class('L')}]", r"[\p{N}]": f"[{_class('N')}]", r"\p{L}": _class("L"), r"\p{N}": _class("N"),
                   r"\s": r" \t-\r\x85\xa0"}
        pattern = split[0]
        for name, inside in classes.items():
            pattern = pattern.replace(name, inside)
        find = re.compile(pattern).findall
        trial = [x + chr(c) + y for c in range(0x180) for x, y in (("a", "b"), ("1", "!"), ("'", "e"))]
        return find if all(find(t.lower()) == self.pieces_of(t) for t in trial) else None

    def merged(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges, by queue and linked list."""
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []  # rank, then position
        for i in range(n - 1):
            m = get(ids[i] << 20 | ids[i + 1])
            if m is not None:
                queue.append((m >> 20) << 32 | i)
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = get(ids[i] << 20 | ids[j])
            if m is None or m >> 20 != top >> 32:
                continue
            ids[i] = new = m & 0xFFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = get(new << 20 | ids[k])
                if m is not None:
                    heappush(queue, (m >> 20) << 32 | i)
            h = before[i]
            if h >= 0:
                m = get(ids[h] << 20 | new)
                if m is not None:
                    heappush(queue, (m >> 20) << 32 | h)
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer; symbols outside the vocabulary have none."""
        letters = list(map(self.letter.__getitem__, piece.encode("utf-8", "surrogatepass")))
        letters[-1] += self.suffix
        return self.merged([x for s in letters if (x := self.vocabulary.get(s)) is not None])

    def __missing__(self, piece: str) -> bytes:
        found = self.piece(piece)
        ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a run between white space, of any characters."""
        ids = self.words.get(word)
        if ids is None:
            parts = []
            for part in self.special.split(word) if self.special else [word]:
                if part in self.added:
                    parts.append(pack("<I", self.added[part]))
                elif part:
                    plain = self.find and not OTHER.search(part)
                    parts += map(self.__getitem__, self.find(part.lower()) if plain else self.pieces_of(part))
            ids = b"".join(parts)
            if len(word) <= KEPT_LENGTH:
                if len(self.words) >= KEPT_WORDS:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        out = []
        for part in parts_of(text or ""):
            if self.find is None or OTHER.search(part) or any(t in part for t in self.added):
                out += map(self.word, words_of(part))
            else:
                out += map(self.__getitem__, self.find(part.lower()))
        return b"".join(out)


def vocabulary_strings(file: str) -> dict[int, str]:
    spec = json.loads(file)
    return {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens") or []}


def _handed_on(rows: Iterator[tuple], schema: pa.Schema, own: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows``; ``own`` is the column whose bytes are counted."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[own]) + 64
        if size >= HAND_ON:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode(docs: DataFrame, file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for each row of ``docs``; ``ids`` is packed, ``file`` the text of a
    tokenizer file.

    Special tokens are not added; where a text spells one, it is that token.  A null or empty
    text has no tokens; a text of any length is encoded whole.  Equal texts give equal ids, repeated rows
    are returned as often as they come, null ids as null; an empty table gives no rows; other
    columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(file or read_file())  # the size of the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_by_worker(sent.value, Encoder)
        for b in batches:
            ids = (encoder.encode(t.as_py()) for t in b.column(1))
            rows = ((k.as_py(), len(x) // 4, x) for k, x in zip(b.column(0), ids))
            yield from _handed_on(rows, pa.schema([("doc_id", b.schema.field(0).type), ("n_tokens", pa.int64()), ("ids", pa.binary())]), 2)

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, file: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, text)``: the strings of packed ids, joined as a file without a decoder asks, by one space.

    Special tokens are kept; ids outside the vocabulary are left out; null ids give an empty text.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(file or read_file())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = held_by_worker(sent.value, vocabulary_strings)
        for b in batches:
            def rows(b: pa.RecordBatch = b) -> Iterator[tuple]:
                for k, x in zip(b.column(0), b.column(1)):
                    x = x.as_py() or b""
                    ids = np.frombuffer(x, "<u4").tolist()
                    try:
                        text = " ".join(map(strings.__getitem__, ids))
                    except KeyError:
                        text = " ".join(strings[i] for i in ids if i in strings)
                    yield k.as_py(), x, text
            yield from _handed_on(rows(), pa.schema([("doc_id", b.schema.field(0).type), ("ids", pa.binary()), ("text", pa.string())]), 2)

    kind = encoded.schema[id_col].dataType.simpleString()
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return src.mapInArrow(run, f"doc_id {kind}, ids binary, text string")
