"""Helpers shared by the operators: table reads, shared scratch tables, column-name hygiene."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any path a Spark reader can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the session is local
    (tests, the smoke check); a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at storage all executors share")
    return _LOCAL_DIRS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="kdframe-llm-"))


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Cuts the lineage, so a lost executor costs a re-read and never a second run of the
    Python work above it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.llm_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does so when the driver's garbage is
    collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables of ``written`` that nothing will read again, and releases shuffle files."""
    spark = tables[0].sparkSession
    for t in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.llm_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def hash_sample(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows of ``df`` with the ``n`` smallest different hashes of ``col``, one row a hash, nulls left out.

    The threshold is found on the hashes alone; only the rows of the sample carry their texts on."""
    keyed = df.filter(F.col(col).isNotNull()).withColumn("llm_hash", F.xxhash64(F.col(col)))
    last = keyed.select("llm_hash").distinct().orderBy("llm_hash").limit(n).agg(F.max("llm_hash")).first()[0]
    few = keyed.filter(F.lit(False) if last is None else F.col("llm_hash") <= last)
    return few.dropDuplicates(["llm_hash"]).orderBy("llm_hash").drop("llm_hash")


def broadcast_if_small(table: DataFrame, limit: int = 10_000) -> DataFrame:
    """A written ``table`` with a broadcast hint if it has at most ``limit`` rows, else as it is (the
    join then shuffles)."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def held_by_worker(source: str, make):
    """``make(source)``, made once in a Python worker and used again by its later tasks.

    Functions are shipped by value, so their own globals do not last from task to task; a module of the
    worker does.  One object of each kind is held, the latest.
    """
    held = sys.modules.setdefault("kdframe_held", types.ModuleType("kdframe_held")).__dict__.setdefault("made", {})
    if held.get(make.__name__, (None,))[0] != source:
        held[make.__name__] = (source, make(source))
    return held[make.__name__][1]
