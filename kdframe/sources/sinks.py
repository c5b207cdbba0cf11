"""Writers of the evaluation and fit artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def eval_csv_frame(scored: DataFrame) -> DataFrame:
    """Detail rows as written to CSV: array columns become JSON text (CSV cannot hold arrays)."""
    cols = []
    for f in scored.schema.fields:
        c = F.col(f.name)
        cols.append(F.to_json(c).alias(f.name) if isinstance(f.dataType, ArrayType) else c)
    return scored.select(*cols)


#: CSV as other readers expect it: quotes doubled, spaces kept, null and '' told apart.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_eval_csv(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV directory per (model, dataset, shot), with header."""
    (eval_csv_frame(scored).write.mode(mode).partitionBy("model", "dataset", "shot").options(**CSV_OPTIONS).csv(path))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV written here, values as they were (line breaks included)."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(path)


def write_summary_csv(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The summary has #models × #datasets × #shots rows, so a single file is written."""
    summary.coalesce(1).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def results_doc(summary: DataFrame, student_col: str = "student") -> DataFrame:
    """One row: ``{student: {"eval_summary": [rows…]}, …}`` as JSON text (one entry per student,
    so the document is as small as the student list)."""
    rows = F.struct("model", "dataset", "shot", "accuracy", "num")
    per = summary.groupBy(student_col).agg(F.array_sort(F.collect_list(rows)).alias("eval_summary"))
    doc = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col(student_col).cast("string"), F.struct("eval_summary"))))).alias("_m"))
    return doc.select(F.to_json("_m").alias("doc"))


def write_results_json(summary: DataFrame, path: str, student_col: str = "student", mode: str = "overwrite") -> None:
    """The results document of one schedule (control or cascade) as a single JSON file."""
    results_doc(summary, student_col).select(F.col("doc").alias("value")).coalesce(1).write.mode(mode).text(path)


def write_fit_log(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Loss history as one JSON list of {run, step, loss} in step order for each run (as many entries
    as the fit made steps)."""
    rows = F.array_sort(F.collect_list(F.struct("run", "step", "loss")))
    history.agg(F.to_json(rows).alias("value")).coalesce(1).write.mode(mode).text(path)
