"""Score generations as they arrive.

The formatters and extractors are plain column expressions, so they apply unchanged to
``readStream`` frames.  A generation stream is joined to the static item table (stream-static
join: the item side is read once per micro-batch, no state), scored, and accuracy per
(model, dataset, shot) is kept as streaming aggregation state.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import score_arc, score_gsm
from ..session import ensure_checkpoint_dir

GENERATION_SCHEMA = "model string, dataset string, shot string, item_id bigint, generation string"


def read_generations(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet generation files dropped into ``path`` as a stream (explicit schema, no inference)."""
    r = spark.readStream.schema(GENERATION_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def scored_stream(gens: DataFrame, items: DataFrame, dataset: str) -> DataFrame:
    """Row-wise scoring of a generation stream against a static item table."""
    if dataset == "GSM8K":
        return score_gsm(gens, items)
    return score_arc(gens, items)


def running_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy and count per (model, dataset, shot), updated every micro-batch."""
    return scored.groupBy("model", "dataset", "shot").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("num"))


def start(df: DataFrame, name: str, sink: str = "memory", output_mode: str = "complete",
          path: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Start a query with its progress kept under the session's reliable checkpoint folder."""
    spark = df.sparkSession
    base = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", base).queryName(name).format(sink)
    if path is not None:
        w = w.option("path", path)
    return w.start()


PAIR_SCHEMA = "pair_id bigint, system string, question string, chosen string, rejected string"


def format_pair_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Preference rows arriving as parquet files → (pair_id, prompt, chosen, rejected); the DPO
    formatter is a row-local projection, so the streaming query keeps no state."""
    from ..operators.conversations import dpo_format
    r = spark.readStream.schema(PAIR_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return dpo_format(r.parquet(path))
