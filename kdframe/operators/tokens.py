"""Vocabulary, encoding, padding and packing of token sequences.

The pretrained subword tokenizers of the source scripts are re-aimed as a word-level vocabulary
fitted on the corpus (count desc, token asc; specials first).  Tokenisation is a JVM regex
(``regexp_extract_all``).  Id lookup takes one of two forms, chosen by the caller: ``udf`` (default)
broadcasts the vocabulary, whose size is a parameter of the fit, to an Arrow UDF that looks ids up
in Arrow's buffers and shuffles nothing; ``join`` joins the different tokens of each block of rows with a vocabulary of any size and
gives the block's rows its dictionary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.arrays import attention_mask, idiv, pad_ids, truncate_ids
from .ordering import prefix_sum
from ..session import materialised
from ..sources.readers import literal_table

# Token pattern (letters/digits/underscore runs, or one other non-space char)
# and the special tokens placed before the fitted vocabulary.
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\x0B\f\r ]"
SPECIALS = ("<unk>", "<eos>")


def tokenize(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(TOKEN_RE), 0)


def fit_vocab(df: DataFrame, text_col: str, size: int, specials=SPECIALS) -> DataFrame:
    """(token, id): specials 0..k-1, then the ``size - k`` most frequent tokens by (count desc, token).

    Counting is a partial (map-side) hash aggregate; only the bounded top list is ranked.
    """
    spark = df.sparkSession
    counts = df.select(F.explode(tokenize(text_col)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    k = len(specials)
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(max(0, size - k))
    # the ranked list is bounded by ``size`` (a parameter), so a single ordered window is fine here
    ranked = top.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token"))) - 1 + k)
                        .cast("int").alias("id"))
    sp = literal_table(spark, [(s, i) for i, s in enumerate(specials)], "token string, id int")
    return sp.unionByName(ranked)


def resolve_pad(vocab: DataFrame, pad_token: str = "<pad>", eos_token: str = "<eos>") -> DataFrame:
    """Pad id falls back to the eos id when the vocabulary has no pad token."""
    return vocab.agg(F.max(F.when(F.col("token") == pad_token, F.col("id"))).alias("_pad"),
                     F.max(F.when(F.col("token") == eos_token, F.col("id"))).alias("eos_id")).select(
        F.coalesce("_pad", "eos_id").alias("pad_id"), "eos_id")


def vocab_id(vocab: DataFrame, token: str) -> int | None:
    row = vocab.where(F.col("token") == token).select("id").first()
    return None if row is None else int(row[0])


#: Indexes of vocabularies that one Python worker holds, by content.
_LOOKUP_CACHE: dict = {}
HELD_VOCABULARIES = 4


def _sent_vocab(vocab: DataFrame):
    """Broadcast of the vocabulary (as many entries as the fit was asked for), and a name for its content."""
    rows = vocab.select("token", "id").collect()
    tag = hashlib.md5(repr(rows).encode()).hexdigest()
    return vocab.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])), tag


def _lookup_udf(bc, tag: str, unk_id: int):
    @F.arrow_udf(ArrayType(IntegerType()))
    def lookup(toks: pa.Array) -> pa.Array:
        cached = _LOOKUP_CACHE.get(tag)
        if cached is None:          # built once per Python worker, reused by every batch
            words, ids = bc.value
            if len(set(words)) < len(words):
                raise ValueError("a token has more than one id")
            cached = (pa.array(words, pa.string()), pa.array(ids, pa.int32()))
            while len(_LOOKUP_CACHE) >= HELD_VOCABULARIES:
                _LOOKUP_CACHE.pop(next(iter(_LOOKUP_CACHE)))
            _LOOKUP_CACHE[tag] = cached
        words, ids = cached
        # Arrow's own buffers throughout: no token becomes a Python object
        found = ids.take(pc.index_in(toks.flatten(), value_set=words)).fill_null(unk_id)
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(toks), 0))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), found, mask=toks.is_null())
    return lookup


def _dictionary_ids(unk_id: int):
    """cogrouped applyInArrow function: the token arrays of a block and the ids of its tokens."""
    def run(rows, known):
        import numpy as np
        import pyarrow as pa
        ids = dict(zip(known.column("token").to_pylist(), known.column("id").to_pylist()))
        out = [None if t is None else np.fromiter((ids.get(x, unk_id) for x in t), np.int32, len(t)) for t in rows.column("_t").to_pylist()]
        return pa.table({"_k": rows.column("_k"), "_ids": pa.array(out, pa.list_(pa.int32()))})
    return run


#: Rows whose tokens share one dictionary.
BLOCK_ROWS = 2048


def encode(df: DataFrame, text_col: str, vocab: DataFrame, out: str = "input_ids", unk_id: int = 0,
           key: str | None = None, method: str = "udf", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Text → id array (unknown → ``unk_id``).

    ``method='udf'`` broadcasts the vocabulary to an Arrow UDF; ``method='join'``, which needs
    a unique ``key``, takes a vocabulary of any size: rows are dealt into blocks by a hash of the key, the different tokens
    of each block are joined with the vocabulary, and a block's rows meet its own small
    dictionary.  A token that is in every row is one row a block of that join.
    """
    if method == "udf":
        return df.withColumn(out, _lookup_udf(*_sent_vocab(vocab), unk_id)(tokenize(text_col)))
    if method != "join":
        raise ValueError(f"unknown method {method!r}")
    if key is None:
        raise ValueError("method='join' needs a unique key column")
    blocks = -(-max(df.select(key).count(), 1) // block_rows)
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")
    rows = df.select(block.alias("_b"), F.col(key).alias("_k"), tokenize(text_col).alias("_t"))
    tokens = rows.select(F.col("_b").alias("_kb"), F.explode(F.array_distinct("_t")).alias("token")).distinct()
    known = tokens.join(vocab.select("token", "id"), "token")
    kind = df.schema[key].dataType.simpleString()
    ids = rows.groupBy("_b").cogroup(known.groupBy("_kb")).applyInArrow(_dictionary_ids(unk_id), f"_k {kind}, _ids array<int>")
    return df.join(ids.withColumnRenamed("_ids", out), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def encode_columns(df: DataFrame, outputs: dict, vocab: DataFrame, unk_id: int = 0) -> DataFrame:
    """Encode several text columns with one broadcast of the vocabulary."""
    fn = _lookup_udf(*_sent_vocab(vocab), unk_id)
    for out, text_col in outputs.items():
        df = df.withColumn(out, F.coalesce(fn(tokenize(text_col)), F.array().cast("array<int>")))
    return df


def batch_length(df: DataFrame, ids_col: str, batch: Column, name: str = "_n") -> DataFrame:
    """``df`` with the longest length of ``ids_col`` among the rows of the same batch."""
    return df.withColumn(name, F.max(F.size(ids_col)).over(Window.partitionBy(batch)))


def encode_padded(df: DataFrame, text_col: str, vocab: DataFrame, n: int | None, pad_id: int, side: str = "right",
                  prefix: str = "", unk_id: int = 0, key: str | None = None, batch: Column | None = None) -> DataFrame:
    """``tokenizer(text, truncation=True, max_length=n, padding='max_length')`` → ids + mask.

    With ``n=None`` nothing is cut and rows are padded to the longest of their ``batch``."""
    enc = encode(df, text_col, vocab, out="_ids", unk_id=unk_id, key=key).withColumn(
        "_ids", F.coalesce("_ids", F.array().cast("array<int>")))
    if n is None:
        enc, ids, size = batch_length(enc, "_ids", batch, "_size"), F.col("_ids"), F.col("_size")
    else:
        ids, size = truncate_ids("_ids", n), n
    return (enc.withColumn(f"{prefix}input_ids", pad_ids(ids, size, pad_id, side))
            .withColumn(f"{prefix}attention_mask", attention_mask(ids, size, side)).drop("_ids", "_size"))


def dual_encode(df: DataFrame, student_text: str, teacher_text: str, svocab: DataFrame, tvocab: DataFrame,
                n: int | None, spad: int, tpad: int, batch: Column | None = None) -> DataFrame:
    """Student and teacher encodings side by side: input_ids/attention_mask and teacher_* columns."""
    out = encode_padded(df, student_text, svocab, n, spad, batch=batch)
    return encode_padded(out, teacher_text, tvocab, n, tpad, prefix="teacher_", batch=batch)


def pack_sequences(df: DataFrame, order_cols, ids_col: str, n: int, bucket: Column | None = None,
                   length: Column | None = None) -> DataFrame:
    """Concatenate id sequences in order and cut into blocks of ``n`` (the last block may be short).

    Offsets are a prefix sum over (key, length) alone; ``length`` may be an expression that needs no
    ids, so they are not made for it.  The ids go once to the range of their keys and are cut and
    put together there; of each range only its first and last block meet those of other
    ranges.  Each row emits the pieces that fall into each block it spans, never single tokens.
    """
    sized = df.withColumn("_len", F.greatest(F.coalesce(F.size(ids_col) if length is None else length, F.lit(0)), F.lit(0)).cast("long"))
    off = prefix_sum(sized, order_cols, weight="_len", bucket=bucket, name="_off", keep_bucket="_range").where(F.col("_len") > 0)
    first = idiv("_off", n)
    last = idiv(F.col("_off") + F.col("_len") - 1, n)

    def piece(block):
        lo = F.greatest(block * n, F.col("_off"))
        hi = F.least((block + 1) * n, F.col("_off") + F.col("_len"))
        ids = F.slice(ids_col, (lo - F.col("_off") + 1).cast("int"), (hi - lo).cast("int"))
        return F.struct(block.alias("block_id"), lo.alias("_start"), ids.alias("_piece"))

    def put_together(pieces: DataFrame, *by: str) -> DataFrame:
        g = pieces.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_start", "_piece"))).alias("_ps"))
        return g.select(*by, F.element_at("_ps", 1)["_start"].alias("_start"), F.flatten(F.transform("_ps", lambda x: x["_piece"])).alias("_piece"))

    # each piece is sliced before the explode, so a long row is not copied once a block
    pieces = off.select("_range", F.inline(F.transform(F.sequence(first.cast("long"), last.cast("long")), piece)))
    local = materialised(put_together(pieces, "_range", "block_id"), "packed")
    whole = F.size("_piece") == n
    rest = put_together(local.where(~whole).drop("_range"), "block_id")
    return local.where(whole).select("block_id", F.col("_piece").alias("input_ids")).unionByName(
        rest.select("block_id", F.col("_piece").alias("input_ids")))


def encode_with_tokenizer(df: DataFrame, text_col: str, make_tokenizer, out: str = "input_ids") -> DataFrame:
    """User tokenizer hook: ``make_tokenizer()`` returns ``fn(list[str]) -> list[list[int]]``
    (e.g. a fast subword tokenizer).  It is built once per Python worker and applied per Arrow
    batch inside a pandas UDF."""
    cache: dict = {}

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        fn = cache.get("fn")
        if fn is None:
            fn = cache["fn"] = make_tokenizer()
        ids = fn(texts.fillna("").tolist())
        return pd.Series([np.asarray(x, dtype=np.int32) for x in ids], index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(text_col)))


def save_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a fitted vocabulary (it is small: at most ``size`` rows) so later jobs over the
    same corpus reuse it instead of refitting."""
    vocab.coalesce(1).write.mode(mode).parquet(path)


def load_vocab(spark, path: str) -> DataFrame:
    return spark.read.schema("token string, id int").parquet(path)
