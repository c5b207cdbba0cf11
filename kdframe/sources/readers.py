"""Dataset readers: explicit-schema scans and a guarded fallback read."""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: What becomes of a JSON or CSV record that does not fit the schema.
CORRUPT = {"raise": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}
CORRUPT_COLUMN = "corrupt_record"


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
                 corrupt: str = "raise", **options) -> DataFrame:
    """Load a table.  Parquet/ORC scans keep column pruning and filter pushdown.

    JSON (one object a line, or ``multiLine``) and CSV (``header``) need a schema: there is no inference pass over the data.
    A record that does not fit it ends the read (``corrupt='raise'``), is left out (``'drop'``), or is
    kept with what could be read, its text in ``corrupt_record`` (``'keep'``).  Text of a CSV is
    as it was written: quotes doubled, spaces kept, empty fields that are not quoted null.
    """
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        if schema is None:
            raise ValueError(f"{fmt} needs a schema")
        reader = reader.option("mode", CORRUPT[corrupt])
        if corrupt == "keep":
            schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
            schema = StructType([*schema.fields, StructField(CORRUPT_COLUMN, StringType())])
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    if fmt == "csv":
        reader = reader.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=False)
    reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


CHOICES = "struct<text:array<string>,label:array<string>>"


def normalise_choices(choices: Column) -> Column:
    """One shape for multiple-choice options: struct(text, label).

    Takes an array of texts, a struct with text and maybe label, or JSON text of either; options without
    labels get A, B, C … in order.  Null, or JSON that is neither, is null."""
    text = F.trim(choices)
    as_list, as_struct = F.from_json(text, "array<string>"), F.from_json(text, CHOICES)
    return F.when(text.startswith("["), labelled(as_list)).when(text.startswith("{"), labelled(as_struct["text"], as_struct["label"]))


def labelled(texts: Column, labels: Column | None = None) -> Column:
    """struct(text, label); labels that are absent, or not one for each text, are A, B, C …"""
    letters = F.transform(texts, lambda _, i: F.chr(i + 65))
    label = letters if labels is None else F.when(F.size(labels) == F.size(texts), labels).otherwise(letters)
    return F.when(texts.isNotNull(), F.struct(texts.alias("text"), label.alias("label")))


def read_choices(spark: SparkSession, path: str, item: str = "item_id long, question string, answerKey string", **options) -> DataFrame:
    """Multiple-choice items from JSON lines whose ``choices`` are a list in some records and an object in others."""
    items = read_dataset(spark, path, "json", f"{item}, choices string", **options)
    return items.withColumn("choices", normalise_choices(F.col("choices")))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-partitioned scan (e.g. one parquet row group) over the cluster's
    cores so CPU-heavy text work runs in parallel.  A no-op once the scan already has at least
    ``defaultParallelism`` splits, which is the case for any large input."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(par) if df.rdd.getNumPartitions() < par else df
    except Exception:  # sessions without RDD access (e.g. a remote client) keep the scan as is
        return df


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small literal table built JVM-side (an inline of literal structs over a one-row range):
    one partition, no Python-backed RDD behind it."""
    st = _parse_datatype_string(schema)
    names = [f.name for f in st.fields]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(*names)


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table by name; the free-text tables (tokenised, regex-scanned) are spread."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def read_with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """Try the full source; if it cannot be resolved (missing path, bad schema) use the fallback.

    Only analysis-time failures are caught: Spark scans lazily, so errors raised later inside
    executors surface at the action, as with any Spark job.
    """
    try:
        df = primary()
        df.schema  # force resolution of files and columns
        return df
    except AnalysisException:
        return fallback()
    except Exception as exc:  # Py4J wrapper of a Java analysis failure
        if "AnalysisException" in type(exc).__name__ or "PATH_NOT_FOUND" in str(exc):
            return fallback()
        raise
