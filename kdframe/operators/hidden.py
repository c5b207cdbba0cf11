"""Layer-wise hidden-state distillation: layer map, per-layer projection, KL per mapped layer.

A projection has two forms.  ``project_hidden`` attaches a layer's matrix to each state and stays in the
JVM: right for adapters of some thousand numbers.  ``project_hidden_tiled`` is for wide dimensions: a
matrix is cut into tiles, states of a layer are dealt over salts, and each (tile, salt) is one
numpy product of bounded size; no row holds a matrix and no task a layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions.arrays import idiv
from ..sources.readers import literal_table


def layer_map(spark, num_student: int | None = None, num_teacher: int | None = None,
              student: DataFrame | None = None, teacher: DataFrame | None = None) -> DataFrame:
    """(student_layer, teacher_layer): i → round_half_even(i·(T−1)/(S−1)).

    Layer counts come from the arguments or from the distinct ``layer`` values of the hidden-state
    tables.  S = 1 divides by zero in the source and is rejected here.
    """
    if student is not None:
        counts = student.agg(F.countDistinct("layer").alias("S")).crossJoin(
            teacher.agg(F.countDistinct("layer").alias("T")))
    else:
        counts = literal_table(spark, [(num_student, num_teacher)], "S long, T long")
    counts = counts.withColumn("_chk", F.when(F.col("S") < 2, F.raise_error(F.lit("layer_map needs at least 2 student layers"))))
    return counts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("S") - 1)).alias("student_layer"),
                         "S", "T", "_chk").select(
        F.col("student_layer").cast("int").alias("student_layer"),
        F.bround(F.col("student_layer") * (F.col("T") - 1) / (F.col("S") - 1), 0).cast("int").alias("teacher_layer"))


def projection_matrices(weights: DataFrame) -> DataFrame:
    """(layer, out_idx, w, b) rows → one row per layer: W (rows in out_idx order) and B."""
    g = weights.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("out_idx", "w", "b"))).alias("_r"))
    return g.select("layer", F.transform("_r", lambda x: sc.as_double(x["w"])).alias("W"),
                    F.transform("_r", lambda x: x["b"]).alias("B"))


def project_hidden(hidden: DataFrame, weights: DataFrame, h_col: str = "h") -> DataFrame:
    """Adapted state per (example, pos, layer): W·h + B; layers without a projection are dropped.

    One join on the layer, with the matrix in the joined row; ``project_hidden_tiled`` is the form for
    wide matrices.  Both sides are cast once, outside the loop over the output dimensions.
    """
    mats = projection_matrices(weights)
    both = hidden.withColumn(h_col, sc.as_double(h_col)).join(mats, "layer", "inner")
    dot = lambda w: F.aggregate(F.zip_with(w, h_col, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return both.withColumn(h_col, F.transform("W", lambda w, o: dot(w) + F.element_at("B", o + 1))).drop("W", "B")


#: Outputs and inputs of a tile, states of a (tile, salt) group: 4 MB and at most 32 MB.
TILE = (512, 1024)
STATES = 4096


def weight_tiles(weights: DataFrame, tile=TILE) -> DataFrame:
    """(layer, out_block, in_block, w, b): the rows of a block of outputs, cut at a block of inputs, end to end."""
    n_out, n_in = tile
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / n_in) - 1, F.lit(0)).cast("int"))
    cut = F.transform(blocks, lambda i: F.struct(i.alias("in_block"), sc.as_double(F.slice("w", i * n_in + 1, n_in)).alias("part")))
    rows = weights.select("layer", "out_idx", "b", idiv("out_idx", n_out).cast("int").alias("out_block"), F.inline(cut))
    g = rows.groupBy("layer", "out_block", "in_block").agg(F.array_sort(F.collect_list(F.struct("out_idx", "part", "b"))).alias("_r"))
    bias = F.transform("_r", lambda x: F.when(F.col("in_block") == 0, x["b"].cast("double")).otherwise(0.0))
    return g.select("layer", "out_block", "in_block", F.flatten(F.transform("_r", lambda x: x["part"])).alias("w"), bias.alias("b"))


def _tile_product(names: list):
    """applyInArrow function: the states of one group times its tile."""
    def run(left, right):
        import numpy as np
        import pyarrow as pa
        if not left.num_rows or not right.num_rows:
            return left.select(names).slice(0, 0).append_column("part", pa.array([], pa.list_(pa.float64())))
        b = right.column("b").combine_chunks().flatten().to_numpy()
        w = right.column("w").combine_chunks().flatten().to_numpy().reshape(len(b), -1)
        x = left.column("x").combine_chunks()
        x = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy()
        if len(x) != left.num_rows * w.shape[1]:
            raise ValueError(f"a state and the projection of its layer differ in size: block of {w.shape[1]} inputs")
        part = x.reshape(left.num_rows, -1) @ w.T + b
        at = np.arange(left.num_rows + 1, dtype=np.int32) * len(b)
        return left.select(names).append_column("part", pa.ListArray.from_arrays(at, part.ravel()))
    return run


def project_hidden_tiled(hidden: DataFrame, weights: DataFrame, h_col: str = "h", tile=TILE, states: int = STATES) -> DataFrame:
    """``project_hidden`` as a tiled matrix product.

    The columns of ``hidden`` other than the state identify a row.  A state is cut into blocks of inputs and
    goes to each block of outputs; groups are (layer, out block, in block, salt) with about ``states``
    states, so a layer with any number of states is spread; parts are summed over the blocks of
    inputs and put end to end.  The number of blocks and of salts come from two small aggregates.
    Layers without a projection are dropped; a state of another size than its projection raises.
    """
    n_out, n_in = tile
    keys = [c for c in hidden.columns if c != h_col]
    dims = weights.agg(F.max("out_idx"), F.max(F.size("w"))).first()
    most = hidden.groupBy("layer").count().agg(F.max("count")).first()[0]
    outs, ins, salts = (dims[0] or 0) // n_out + 1, -(-max(dims[1] or 1, 1) // n_in), -(-(most or 1) // states)
    group = ["layer", "out_block", "in_block", "salt"]
    cut = F.transform(F.sequence(F.lit(0), F.lit(ins - 1)),
                      lambda i: F.struct(i.alias("in_block"), sc.as_double(F.slice(h_col, i * n_in + 1, n_in)).alias("x")))
    salt = F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")
    left = (hidden.select(*keys, salt.alias("salt"), F.inline(cut))
            .withColumn("out_block", F.explode(F.sequence(F.lit(0), F.lit(outs - 1)))))
    right = weight_tiles(weights, tile).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names = [*keys, "out_block", "in_block"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(names).schema.fields)
    parts = left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(_tile_product(names), f"{kinds}, part array<double>")
    g = parts.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct("out_block", "in_block", "part"))).alias("_p"))
    if ins == 1:
        return g.withColumn(h_col, F.flatten(F.transform("_p", lambda p: p["part"]))).drop("_p")

    def block(o: Column) -> Column:
        own = F.transform(F.filter("_p", lambda p: p["out_block"] == o), lambda p: p["part"])
        zero = F.transform(F.element_at(own, 1), lambda v: v * 0)
        return F.aggregate(own, zero, lambda acc, part: F.zip_with(acc, part, lambda x, y: x + y))

    have = F.array_distinct(F.transform("_p", lambda p: p["out_block"]))
    return g.withColumn(h_col, F.flatten(F.transform(have, block))).drop("_p")


def hidden_kd_loss(student: DataFrame, teacher: DataFrame, weights: DataFrame, temperature: float = 2.0,
                   alpha: float = 0.5, ce: DataFrame | None = None, batch_col: str = "batch_id",
                   num_student: int | None = None, num_teacher: int | None = None, mask: Column | None = None,
                   project=project_hidden) -> DataFrame:
    """(batch_id, kd, ce, loss): per mapped layer batchmean KL · T², mean over layers, ÷ hidden dim,
    α-mixed with CE.  A dimension mismatch between adapted student and teacher state raises.
    Positions outside the (optional) ``mask`` over the student's columns count zero.  ``project`` is
    ``project_hidden_tiled`` for wide states."""
    spark = student.sparkSession
    if num_student is not None and num_teacher is not None:      # model config known: no scan
        lm = F.broadcast(layer_map(spark, num_student, num_teacher))
    else:                                                          # else count distinct layers
        lm = F.broadcast(layer_map(spark, student=student, teacher=teacher))
    # only mapped teacher layers are shuffled
    s = project(student.join(lm, F.col("layer") == F.col("student_layer")), weights)
    used = F.broadcast(lm.select("teacher_layer").distinct())
    t = teacher.select("example_id", "pos", F.col("layer").alias("teacher_layer"), F.col("h").alias("t")).join(used, "teacher_layer", "left_semi")
    j = s.join(t, ["example_id", "pos", "teacher_layer"], "inner").withColumn("s", F.when(F.size("h") == F.size("t"), F.col("h")).otherwise(
        F.raise_error(F.concat(F.lit("the adapted student state has "), F.size("h").cast("string"),
                               F.lit(" numbers, the teacher state "), F.size("t").cast("string")))))
    kl = sc.kl_row("s", "t", temperature)
    rows = j.withColumn("kl", kl if mask is None else F.when(mask, kl).otherwise(0.0))
    per_ex = rows.groupBy(batch_col, "student_layer", "example_id").agg(F.sum("kl").alias("_kl"),
                                                                      F.max(F.size("s")).alias("_dim"))
    per_layer = per_ex.groupBy(batch_col, "student_layer").agg(
        (F.sum("_kl") / F.count("*") * temperature ** 2).alias("_lk"), F.max("_dim").alias("_dim"))
    kd = per_layer.groupBy(batch_col).agg((F.avg("_lk") / F.max("_dim")).alias("kd"))
    if ce is None:
        return kd.withColumn("ce", F.lit(None).cast("double")).withColumn("loss", alpha * F.col("kd"))
    return kd.join(ce, batch_col, "left").withColumn("loss", alpha * F.col("kd") + (1 - alpha) * F.col("ce"))
