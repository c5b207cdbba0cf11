"""Sequence operators of the preference forward pass, on per-row token arrays.

Rows are (batch_id, row, ...) with ``row`` the position of the sequence in the stacked
2N-row batch (chosen rows first).  Facts of a batch (its size, the flush-left cut, logits_to_keep) are
windows over narrow facts of its rows, so the chain stays one lineage: rows are brought together
by batch once and nothing is joined back.  No token is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import attention_mask, first_one, pad_ids, roll_left, rotate_left, runs_of_ones, scatter, truncate_seq as _trunc, zeros_like


def pad_pairs(encoded: DataFrame, pad_id: int, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected",
              batch_col: str = "batch_id", pair_col: str = "pair_id") -> DataFrame:
    """Id arrays → wide pair rows with ids and masks, as a collator does: prompts left-padded to the longest
    prompt of the batch, completions right-padded to its longest completion; nothing is cut."""
    batch = Window.partitionBy(batch_col)
    e = (encoded.withColumn("_np", F.max(F.size(prompt)).over(batch))
         .withColumn("_nc", F.max(F.greatest(F.size(chosen), F.size(rejected))).over(batch)))
    sides = [("prompt", prompt, "_np", "left"), ("chosen", chosen, "_nc", "right"), ("rejected", rejected, "_nc", "right")]
    padded = [x for name, c, n, side in sides for x in (pad_ids(c, F.col(n), pad_id, side).alias(f"{name}_ids"),
                                                        attention_mask(c, F.col(n), side).alias(f"{name}_mask"))]
    return e.select(batch_col, pair_col, *padded)


def stack_pairs(pairs: DataFrame, batch_col: str = "batch_id", pair_col: str = "pair_id") -> DataFrame:
    """Wide pair rows → 2N stacked rows per batch, chosen first; ``row`` = index in the batch."""
    batch = Window.partitionBy(batch_col)
    ranked = pairs.withColumn("_r", F.row_number().over(batch.orderBy(pair_col)) - 1).withColumn("_n", F.count("*").over(batch))

    def side(name: str, row: Column) -> Column:
        return F.struct(F.lit(name).alias("side"), row.cast("long").alias("row"), F.col(f"{name}_ids").alias("completion_ids"),
                        F.col(f"{name}_mask").alias("completion_mask"))

    both = F.array(side("chosen", F.col("_r")), side("rejected", F.col("_r") + F.col("_n")))
    return ranked.select(batch_col, pair_col, "prompt_ids", "prompt_mask", F.inline(both))


def concat_prompt_completion(df: DataFrame) -> DataFrame:
    """input_ids / attention_mask = prompt ‖ completion; loss_mask = zeros(prompt) ‖ completion mask."""
    return (df.withColumn("input_ids", F.concat("prompt_ids", "completion_ids"))
            .withColumn("attention_mask", F.concat("prompt_mask", "completion_mask"))
            .withColumn("loss_mask", F.concat(zeros_like("prompt_mask"), F.col("completion_mask")))
            .drop("prompt_ids", "prompt_mask", "completion_ids", "completion_mask"))


def flush_left(df: DataFrame, batch_col: str = "batch_id", mask: str = "attention_mask",
               others=("input_ids", "loss_mask")) -> DataFrame:
    """Rotate each row left by the index of its first mask 1, then cut the batch at its first
    all-zero mask column.  A row without any 1 becomes empty (the source would raise)."""
    k = first_one(mask)
    out = df.withColumn("_k", k)
    for c in (mask, *others):
        out = out.withColumn(c, F.when(F.col("_k") < 0, F.array().cast(out.schema[c].dataType))
                             .otherwise(rotate_left(c, F.col("_k"))))
    # a row tells its runs of ones; the batch's runs, by start, cover columns up to the first gap
    runs = F.array_sort(F.flatten(F.collect_list("_runs").over(Window.partitionBy(batch_col))))
    cover = F.aggregate(runs, F.lit(0), lambda c, r: F.when(r["start"] <= c, F.greatest(c, r["stop"])).otherwise(c))
    out = out.withColumn("_runs", runs_of_ones(mask)).withColumn("_cut", cover)
    for c in (mask, *others):
        out = out.withColumn(c, F.slice(c, 1, F.col("_cut")))
    return out.drop("_k", "_runs", "_cut")


def truncate_rows(df: DataFrame, n: int, mode: str = "keep_end",
                  cols=("input_ids", "attention_mask", "loss_mask")) -> DataFrame:
    """``keep_end`` / ``keep_start`` on every sequence column; other modes raise."""
    for c in cols:
        df = df.withColumn(c, _trunc(c, n, mode))
    return df


def shift_labels(df: DataFrame, ids: str = "input_ids", loss_mask: str = "loss_mask") -> DataFrame:
    """Next-token labels: roll −1 (wrapping) of ids and loss mask."""
    return df.withColumn("labels", roll_left(ids)).withColumn("label_mask", roll_left(loss_mask))


def token_rows(df: DataFrame, keep=("batch_id", "pair_id", "side", "row"), ids: str = "input_ids",
               cols=("labels", "label_mask")) -> DataFrame:
    """One row a position, the form that stored scores have: (keep…, pos, input_id, label, loss_mask)."""
    zipped = F.arrays_zip(F.col(ids).alias("input_id"), F.col(cols[0]).alias("label"), F.col(cols[1]).alias("loss_mask"))
    return df.select(*keep, F.posexplode(zipped).alias("pos", "_t")).select(*keep, "pos", "_t.*")


def logits_to_keep(df: DataFrame, batch_col: str = "batch_id", loss_mask: str = "loss_mask") -> DataFrame:
    """Batch-wide ``seq_len − min(first loss position) + 1``; labels and label mask sliced to that tail."""
    batch = Window.partitionBy(batch_col)
    first = F.when(first_one(loss_mask) >= 0, first_one(loss_mask))
    facts = shift_labels(df).withColumn("_f", first).withColumn("_l", F.size(loss_mask))
    keep = (F.max("_l").over(batch) - F.min("_f").over(batch) + 1).cast("int")
    out = facts.withColumn("logits_to_keep", keep).drop("_f", "_l")
    for c in ("labels", "label_mask"):
        start = F.greatest(F.size(c) - F.col("logits_to_keep") + 1, F.lit(1))
        out = out.withColumn(c, F.slice(c, start, F.col("logits_to_keep")))
    return out


def pack_padding_free(df: DataFrame, batch_col: str = "batch_id", row_col: str = "row",
                      ids: str = "input_ids", mask: str = "attention_mask", loss_mask: str = "loss_mask",
                      keep=()) -> DataFrame:
    """Drop padding, concatenate the batch's rows in row order; position_ids restart at 0 per row.

    ``rows`` tells where the tokens came from: (row, the columns in ``keep``, mask) in row order."""
    kept = df.select(batch_col, row_col, mask, *keep,
                     F.filter(F.arrays_zip(F.col(ids).alias("i"), F.col(mask).alias("m"), F.col(loss_mask).alias("l")),
                              lambda x: x["m"] == 1).alias("_z"))
    g = kept.groupBy(batch_col).agg(F.array_sort(F.collect_list(F.struct(row_col, *keep, mask, "_z"))).alias("_rows"))
    return g.select(batch_col,
                    F.flatten(F.transform("_rows", lambda r: F.transform(r["_z"], lambda x: x["i"]))).alias("input_ids"),
                    F.flatten(F.transform("_rows", lambda r: F.transform(r["_z"], lambda x, j: j))).alias("position_ids"),
                    F.flatten(F.transform("_rows", lambda r: F.transform(r["_z"], lambda x: x["l"]))).alias("loss_mask"),
                    F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in (row_col, *keep)], r[mask].alias("mask"))).alias("rows"))


def unpack_padding_free(packed: DataFrame, grid: DataFrame | None = None, values: str = "input_ids", batch_col: str = "batch_id",
                        row_col: str = "row", mask: str = "attention_mask") -> DataFrame:
    """Scatter packed per-token values back to their rows; 0 where the mask is 0.

    ``rows`` of the packed batch has the masks, or a ``grid`` of (batch, row, mask) does.  A row's values
    begin after the ones of the rows before it, are one slice, and go to its runs of ones."""
    if grid is not None:
        rows = grid.groupBy(batch_col).agg(F.array_sort(F.collect_list(F.struct(row_col, F.col(mask).alias("mask")))).alias("rows"))
        packed = packed.drop("rows").join(rows, batch_col)
    ones = lambda r: F.size(F.filter(r["mask"], lambda m: m == 1))
    begin = F.aggregate("rows", F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + ones(r))))
    names = [f.name for f in packed.schema["rows"].dataType.elementType.fields if f.name != "mask"]
    flat = packed.withColumn("_begin", begin).select(batch_col, F.col(values).alias("_v"), "_begin", F.posexplode("rows").alias("_i", "_r"))
    own = F.slice("_v", F.element_at("_begin", F.col("_i") + 1) + 1, ones(F.col("_r")))
    cut = flat.select(batch_col, *[F.col(f"_r.{c}").alias(c) for c in names], F.col("_r.mask").alias("_m"), own.alias("_v"))
    return cut.withColumn(values, scatter("_v", "_m")).drop("_v", "_m")


def split_packed(packed: DataFrame, n_pairs: DataFrame | None = None, batch_col: str = "batch_id") -> DataFrame:
    """Index of the (N+1)-th ``position_ids == 0`` = first rejected token of the packed batch; N is half the
    packed ``rows``, or ``n_pairs`` of a table of (batch, n_pairs)."""
    n = F.floor(F.size("rows") / 2) if n_pairs is None else F.col("n_pairs")
    packed = packed if n_pairs is None else packed.join(n_pairs, batch_col)
    zeros = F.filter(F.transform("position_ids", lambda p, i: F.when(p == 0, i).otherwise(-1)), lambda x: x >= 0)
    return packed.select(batch_col, F.try_element_at(zeros, (n + 1).cast("int")).alias("split_idx"))


def tail_align_logits(logits: DataFrame, labels_len: DataFrame, example_col: str = "example_id",
                      pos_col: str = "pos") -> DataFrame:
    """Logits longer than the labels keep their last ``seq_len`` positions (re-indexed from 0)."""
    n = logits.groupBy(example_col).agg((F.max(pos_col) + 1).alias("_n"))
    j = logits.join(n, example_col).join(labels_len, example_col)
    off = F.greatest(F.col("_n") - F.col("seq_len"), F.lit(0))
    return (j.where(F.col(pos_col) >= off).withColumn(pos_col, (F.col(pos_col) - off).cast("int"))
            .drop("_n", "seq_len"))
