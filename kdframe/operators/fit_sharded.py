"""The linear fit of ``fit`` with its weights as a table, for models that no driver and no task should hold.

Rows are packed into blocks, classes into blocks: a weight block is (class block × features), a teacher
block (rows × class block).  A step joins row blocks with weight blocks, takes each product in numpy
twice: once for the normalisers of every row over all class blocks, once for the gradient of a class block.
Gradients are summed by (class, feature) and joined to the weights by class.  The driver sees the
number of classes and a loss a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions.arrays import idiv
from ..session import materialised
from .fit import HISTORY

#: Classes of a weight block, rows of a row block.
CLASS_BLOCK, ROW_BLOCK = 512, 1024


def _row_blocks(df: DataFrame, features: str, teacher_logits: str, label: str, temperature: float, class_block: int, row_block: int):
    """(rows, teacher): packed features and labels by block, log-probabilities of the teacher by block and class block."""
    y, k = F.col(label).cast("int"), F.size(teacher_logits)
    wrong = F.raise_error(F.concat(F.lit("label "), F.coalesce(y.cast("string"), F.lit("null")), F.lit(" is outside the classes")))
    one = df.select(sc.as_double(features).alias("x"), sc.log_softmax_t(teacher_logits, temperature).alias("t"),
                    F.when((y >= 0) & (y < k), y).otherwise(wrong.cast("int")).alias("y"))
    # written with their ids, so that blocks are the same in every later step; a block is of one input partition
    one = materialised(one.withColumn("id", F.monotonically_increasing_id()).withColumn("block", idiv("id", row_block)), "fit_rows")
    # rows of a block in the order of their ids
    packed = one.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("r"))
    rows = packed.select("block", F.flatten(F.transform("r", lambda r: r["x"])).alias("x"), F.transform("r", lambda r: r["y"]).alias("y"))
    blocks = F.sequence(F.lit(0), F.ceil(F.size("t") / class_block).cast("int") - 1)
    cut = F.transform(blocks, lambda i: F.struct(i.alias("cb"), F.slice("t", i * class_block + 1, class_block).alias("p")))
    parts = one.select("block", "id", F.inline(cut)).groupBy("block", "cb").agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("r"))
    teacher = parts.select("block", "cb", F.flatten(F.transform("r", lambda r: r["p"])).alias("t"))
    return materialised(rows, "fit_x"), materialised(teacher, "fit_t")


def _product():
    """(batch, row) → logits (rows × classes) of one joined row, with its features.  Like all that workers run here, a
    nested function, which is shipped by value."""
    def product(batch, i):
        import numpy as np
        part = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
        w, b = part("w"), part("b")
        x = part("x").reshape(-1, len(w) // len(b))
        return x, np.ascontiguousarray(x @ w.reshape(len(b), -1).T + b)
    return product


def _normalisers(temperature: float):
    """mapInArrow: of each row of a block, maximum and sum of exponents over one class block, at both temperatures."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                _, z = product(batch, i)
                sums = []
                for t in (1.0, temperature):
                    top = z.max(axis=1) / t
                    sums += [top, np.exp(z / t - top[:, None]).sum(axis=1)]
                out.append(np.concatenate(sums))
            yield pa.record_batch([batch.column("block"), pa.array(out, pa.list_(pa.float64()))], names=["block", "s"])
    product = _product()
    return run


def _joined_normalisers():
    """applyInArrow: the normalisers of a block's rows over all class blocks."""
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        s = np.stack([x.values.to_numpy(zero_copy_only=False) for x in table.column("s").combine_chunks()]).reshape(table.num_rows, 4, -1)
        lse = []
        for top, total in ((s[:, 0], s[:, 1]), (s[:, 2], s[:, 3])):
            most = top.max(axis=0)
            lse.append(most + np.log((total * np.exp(top - most)).sum(axis=0)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "lse": pa.array([np.concatenate(lse)], pa.list_(pa.float64()))})
    return run


def _gradients(temperature: float, alpha: float, class_block: int):
    """mapInArrow: (class, feature, value) of a partition's gradient; the intercept is feature −1, the loss class −1."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        total, loss, n = {}, 0.0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                x, z = product(batch, i)
                cb, y = batch.column("cb")[i].as_py(), batch.column("y")[i].values.to_numpy(zero_copy_only=False)
                lse1, lse_t = batch.column("lse")[i].values.to_numpy(zero_copy_only=False).reshape(2, -1)
                lt = batch.column("t")[i].values.to_numpy(zero_copy_only=False).reshape(z.shape)
                ls_t, ls, p = z / temperature - lse_t[:, None], z - lse1[:, None], np.exp(lt)
                own = np.flatnonzero((y >= cb * class_block) & (y < cb * class_block + z.shape[1]))
                at = y[own] - cb * class_block
                hard = np.exp(ls)
                hard[own, at] -= 1.0
                g = alpha * temperature * (np.exp(ls_t) - p) + (1 - alpha) * hard
                loss += float(alpha * temperature ** 2 * (p * (lt - ls_t)).sum() - (1 - alpha) * ls[own, at].sum())
                n += len(own)                                  # a row's label is in one class block
                both = np.concatenate([g.T @ x, g.sum(axis=0)[:, None]], axis=1)
                total[cb] = total[cb] + both if cb in total else both
        for cb, both in total.items():
            k, d = both.shape
            feature = np.tile(np.append(np.arange(d - 1), -1), k)
            yield pa.record_batch([pa.array(np.repeat(np.arange(k) + cb * class_block, d), pa.int32()), pa.array(feature, pa.int32()), pa.array(both.ravel())],
                                  names=["class", "feature", "value"])
        yield pa.record_batch([pa.array([-1, -1], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([loss, float(n)])], names=["class", "feature", "value"])
    product = _product()
    return run


def distil_linear_sharded(df: DataFrame, features: str, teacher_logits: str, label: str, temperature: float = 2.0, alpha: float = 0.5,
                          iters: int = 50, lr: float = 0.5, run: str = "run", class_block: int = CLASS_BLOCK, row_block: int = ROW_BLOCK):
    """``fit.distil_linear`` with the weights as a table: (weights DataFrame (class, w, b), history DataFrame).

    The same steps and losses.  Labels outside 0..K−1, null ones too, are an error; an empty table gives empty weights
    and no steps."""
    spark = df.sparkSession
    rows, teacher = _row_blocks(df, features, teacher_logits, label, temperature, class_block, row_block)
    shape = df.select(F.size(features).alias("d"), F.size(teacher_logits).alias("k")).first()
    kinds = "class int, w array<double>, b double"
    if shape is None:
        return spark.createDataFrame([], kinds), spark.createDataFrame([], HISTORY)
    zero = F.array_repeat(F.lit(0.0), shape["d"])
    weights = materialised(spark.range(shape["k"]).select(F.col("id").cast("int").alias("class"), zero.alias("w"), F.lit(0.0).alias("b")), "fit_w")
    blocks = -(-shape["k"] // class_block)
    spread = rows.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    history = []
    for step in range(iters + 1):
        packed = weights.groupBy(idiv("class", class_block).cast("int").alias("cb")).agg(F.array_sort(F.collect_list(F.struct("class", "w", "b"))).alias("r"))
        packed = packed.select("cb", F.flatten(F.transform("r", lambda r: r["w"])).alias("w"), F.transform("r", lambda r: r["b"]).alias("b"))
        both = spread.join(packed, "cb")
        sums = both.select("block", "x", "w", "b").mapInArrow(_normalisers(temperature), "block long, s array<double>")
        norm = sums.groupBy("block").applyInArrow(_joined_normalisers(), "block long, lse array<double>")
        parts = both.join(norm, "block").join(teacher, ["block", "cb"]).mapInArrow(
            _gradients(temperature, alpha, class_block), "class int, feature int, value double")
        grads = materialised(parts.groupBy("class", "feature").agg(F.sum("value").alias("value")), "fit_g")
        last = {r["feature"]: r["value"] for r in grads.where("class = -1").collect()}          # loss and number of rows
        history.append((run, step, last[0] / last[1]))
        if step == iters:
            break
        rate = lr / last[1]
        by_class = grads.where("class >= 0").groupBy("class").agg(
            F.array_sort(F.collect_list(F.when(F.col("feature") >= 0, F.struct("feature", "value")))).alias("g"),
            F.sum(F.when(F.col("feature") == -1, F.col("value"))).alias("gb"))
        moved = weights.join(by_class, "class").select(
            "class", F.zip_with("w", "g", lambda w, g: w - rate * g["value"]).alias("w"), (F.col("b") - rate * F.col("gb")).alias("b"))
        weights = materialised(moved, "fit_w")
    return weights, spark.createDataFrame(history, HISTORY)
