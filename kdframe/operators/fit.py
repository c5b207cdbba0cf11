"""Distillation runs re-aimed to Spark: multinomial linear students fitted to a teacher's
soft labels by full-batch gradient descent.

Any number of students is fitted at once: per iteration the (small) weights are broadcast, every
partition computes the partial gradients of all students with numpy inside ``mapInPandas`` and emits
them as (student, index, value) rows, which a hash aggregate sums with map-side combine: nothing is
gathered by partition, whatever their number, and a step is one scan.  The input is cached once; only
the weights change between iterations.  Between cascade stages the student scores are
reliably checkpointed so lineage does not grow with the number of stages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.readers import literal_table


@dataclass(frozen=True)
class StudentSpec:
    name: str
    features: tuple          # indices into the feature array used by this student


def _partials(bc, temperature: float, alpha: float):
    """mapInPandas function: per student partial gradient sums and loss of one partition as rows.

    Everything the workers run is defined in here, so it is shipped by value and the workers do
    not need this package installed."""
    def _log_softmax(z):
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def run(batches):
        models = bc.value
        sums = [[np.zeros_like(w), np.zeros_like(b), 0.0] for w, b, _ in models]
        n = 0
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
            t = np.stack(pdf["t"].to_numpy()).astype(np.float64)
            y = pdf["y"].to_numpy().astype(np.int64)
            at, n = np.arange(len(y)), n + len(y)
            lt_t = _log_softmax(t / temperature)
            pt_t = np.exp(lt_t)
            for (w, b, features), total in zip(models, sums):
                xs = x if features is None else x[:, features]
                z = xs @ w.T + b
                ls_t, ls = _log_softmax(z / temperature), _log_softmax(z)
                kl = (pt_t * (lt_t - ls_t)).sum(axis=1)
                soft, hard = np.exp(ls_t) - pt_t, np.exp(ls)
                hard[at, y] -= 1.0
                g = alpha * temperature * soft + (1 - alpha) * hard
                total[0] += g.T @ xs
                total[1] += g.sum(axis=0)
                total[2] += float((alpha * temperature ** 2 * kl - (1 - alpha) * ls[at, y]).sum())
        for i, (gw, gb, loss) in enumerate(sums):
            vals = np.concatenate([gw.ravel(), gb, [loss, float(n)]])
            yield pd.DataFrame({"student": i, "idx": np.arange(len(vals), dtype=np.int64), "val": vals})
    return run


HISTORY = "run string, step int, loss double"


def fit_students(df: DataFrame, students, features: str, teacher_logits: str, label: str, temperature: float = 2.0,
                 alpha: float = 0.5, iters: int = 50, lr: float = 0.5, history: list | None = None) -> list[dict]:
    """Fit each of ``students`` (run name, indices of its features or None for all) to one teacher, all in
    the same scan a step, by gradient descent on α·T²·KL(p_t^T ‖ p_s^T) + (1−α)·CE.

    Returns per student its weights, a dict of numpy W (K × D) and b; ``history`` takes (run, step, loss)
    of each student, step by step.  Labels outside 0..K−1, null ones too, are an error.  An empty table gives
    weights without rows and no steps.
    """
    spark = df.sparkSession
    history = [] if history is None else history
    y, k_of = F.col(label).cast("int"), F.size(teacher_logits)
    wrong = F.raise_error(F.concat(F.lit("label "), F.coalesce(y.cast("string"), F.lit("null")), F.lit(" is outside the classes")))
    data = df.select(F.col(features).alias("x"), F.col(teacher_logits).alias("t"),
                     F.when((y >= 0) & (y < k_of), y).otherwise(wrong.cast("int")).alias("y"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = data.select(F.size("x").alias("d"), F.size("t").alias("k")).first()
        if first is None:
            return [{"W": np.zeros((0, 0)), "b": np.zeros(0)} for _ in students]
        k, sizes = int(first["k"]), [int(first["d"]) if f is None else len(f) for _, f in students]
        models = [(np.zeros((k, d)), np.zeros(k), None if f is None else np.asarray(f)) for d, (_, f) in zip(sizes, students)]
        for step in range(iters + 1):
            bc = spark.sparkContext.broadcast(models)
            parts = data.mapInPandas(_partials(bc, temperature, alpha), "student int, idx long, val double")
            tot = parts.groupBy("student", "idx").agg(F.sum("val").alias("val")).toPandas()     # K·D + K + 2 rows a student: the weights
            sums = {i: g.sort_values("idx")["val"].to_numpy() for i, g in tot.groupby("student")}
            bc.unpersist()
            for i, (d, (run, _)) in enumerate(zip(sizes, students)):
                vec, (w, b, f) = sums[i], models[i]
                history.append((run, step, float(vec[-2] / vec[-1])))
                g = vec / vec[-1]
                if step < iters:
                    models[i] = (w - lr * g[: k * d].reshape(k, d), b - lr * g[k * d: k * d + k], f)
        return [{"W": w, "b": b} for w, b, _ in models]
    finally:
        data.unpersist()


def distil_linear(df: DataFrame, features: str, teacher_logits: str, label: str, temperature: float = 2.0,
                  alpha: float = 0.5, iters: int = 50, lr: float = 0.5, run: str = "run", history: list | None = None):
    """One student over all features (see ``fit_students``).

    Returns (weights dict with numpy W, b; history DataFrame (run, step, loss)).  ``alpha = 0``
    is plain multinomial logistic regression.  A ``history`` list is filled step by step, so a
    caller has it even if a later step fails.
    """
    history = [] if history is None else history
    weights, = fit_students(df, [(run, None)], features, teacher_logits, label, temperature, alpha, iters, lr, history)
    return weights, df.sparkSession.createDataFrame(history, HISTORY)


def distil_and_log(df: DataFrame, features: str, teacher_logits: str, label: str, log_path: str, **kw):
    """Fit and write the loss history; as in the source the log is written even when the fit
    fails (the error is then re-raised after the partial history is saved)."""
    from ..sources.sinks import write_fit_log
    steps: list = []
    try:
        return distil_linear(df, features, teacher_logits, label, history=steps, **kw)
    finally:
        write_fit_log(df.sparkSession.createDataFrame(steps, HISTORY), log_path)


#: Bytes of weights up to which a model is sent to every executor.
SENT = 64 << 20


def model_table(spark, weights: dict) -> DataFrame:
    """One row (W, b), broadcast up to ``SENT`` bytes."""
    w, b = np.asarray(weights["W"], float), np.asarray(weights["b"], float)
    model = spark.createDataFrame([(w.tolist(), b.tolist())], "W array<array<double>>, b array<double>")
    return F.broadcast(model) if w.nbytes <= SENT else model


def score_linear(df: DataFrame, features: str, weights, out: str = "logits") -> DataFrame:
    """Student logits W·x + b.  The weights are data, a dict of arrays or a one-row table (W, b), joined to every
    row and applied by JVM expressions, so plans don't grow with them."""
    model = model_table(df.sparkSession, weights) if isinstance(weights, dict) else weights
    model = model.select(F.col("W").alias("_W"), F.col("b").alias("_b"))
    x = F.transform(features, lambda v: v.cast("double"))
    logits = F.zip_with("_W", "_b", lambda r, b: F.aggregate(F.zip_with(r, F.col("_x"), lambda p, q: p * q), b, lambda acc, v: acc + v))
    return df.withColumn("_x", x).crossJoin(model).withColumn(out, logits).drop("_W", "_b", "_x")


def select_features(df: DataFrame, features: str, idx, out: str = "x_sub") -> DataFrame:
    arr = F.array(*[F.element_at(features, int(i) + 1) for i in idx])
    return df.withColumn(out, arr)


def _accuracies(df: DataFrame, students, weights: list[dict], features: str, label: str) -> tuple[DataFrame, list]:
    """``df`` with the logits of each student, and their accuracies from one pass."""
    for i, (s, w) in enumerate(zip(students, weights)):
        df = score_linear(select_features(df, features, s.features), "x_sub", w, f"logits_{i}").drop("x_sub")
    right = [F.avg((F.array_position(f"logits_{i}", F.array_max(f"logits_{i}")) - 1 == F.col(label)).cast("double")) for i in range(len(students))]
    return df, list(df.agg(*[r.alias(f"a{i}") for i, r in enumerate(right)]).first())


SUMMARY_SCHEMA = "mode string, stage int, teacher string, student string, final_loss double, train_accuracy double"


def _last_loss(history: list, run: str):
    return max(((step, loss) for r, step, loss in history if r == run), default=(0, None))[1]


def distil_control(df: DataFrame, students, features: str = "features", teacher_logits: str = "teacher_logits",
                   label: str = "label", teacher: str = "teacher", **kw):
    """Original teacher → each student independently, all fitted in the same scans."""
    spark, students, history = df.sparkSession, list(students), []
    runs = [(f"control/{s.name}", s.features) for s in students]
    weights = fit_students(df, runs, features, teacher_logits, label, history=history, **kw)
    _, accuracy = _accuracies(df, students, weights, features, label) if history else (None, [None] * len(students))
    rows = [("control", i, teacher, s.name, _last_loss(history, run), a)
            for i, (s, (run, _), a) in enumerate(zip(students, runs, accuracy), start=1)]
    return spark.createDataFrame(rows, SUMMARY_SCHEMA), spark.createDataFrame(history, HISTORY)


def distil_cascade(df: DataFrame, students, features: str = "features", teacher_logits: str = "teacher_logits",
                   label: str = "label", teacher: str = "teacher", key: str = "id", **kw):
    """teacher → s1 → s2 → …: each fitted student's scores teach the next one."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows, history = [], []
    current, current_name = df, teacher
    for i, s in enumerate(students, start=1):
        run = f"cascade/{s.name}"
        weights = fit_students(current, [(run, s.features)], features, teacher_logits, label, history=history, **kw)
        if not history:          # no rows: nothing to score or to teach
            rows.append(("cascade", i, current_name, s.name, None, None))
            current_name = s.name
            continue
        scored, (accuracy,) = _accuracies(current, [s], weights, features, label)
        rows.append(("cascade", i, current_name, s.name, _last_loss(history, run), accuracy))
        # the fitted student becomes the teacher: materialise its scores to cut the lineage
        current = scored.select(key, features, label, F.col("logits_0").alias(teacher_logits)).checkpoint(eager=True)
        current_name = s.name
    return spark.createDataFrame(rows, SUMMARY_SCHEMA), spark.createDataFrame(history, HISTORY)


def run_plan(students: DataFrame, teacher: str, student_col: str = "student", order_col: str = "stage") -> DataFrame:
    """(mode, stage, teacher, student, label, out_dir) for the control and cascade schedules.

    The student list is a small table (one row per student); ``lag`` runs per mode.
    """
    modes = literal_table(students.sparkSession, [("control",), ("cascade",)], "mode string")
    grid = students.select(F.col(order_col).cast("int").alias("stage"), F.col(student_col).alias("student")).crossJoin(
        F.broadcast(modes))
    prev = F.lag("student").over(Window.partitionBy("mode").orderBy("stage"))
    t = F.when(F.col("mode") == "control", F.lit(teacher)).otherwise(F.coalesce(prev, F.lit(teacher)))
    label = F.regexp_replace("student", "/", "_")
    return grid.select("mode", "stage", t.alias("teacher"), "student", label.alias("label"),
                       F.concat(F.col("mode"), F.lit("/stage_"), F.col("stage").cast("string"), F.lit("_"), label)
                       .alias("out_dir"))
