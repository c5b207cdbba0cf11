"""Session helpers: a tuned local session for tests / bench and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CKPT: dict[str, str] = {}


def _default_driver_memory() -> str:
    """Local mode runs everything in the driver JVM: give it ~60 % of RAM, at most 16 GiB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2 ** 30)))}g"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "kdframe", event_log_dir: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every entry point here assumes.

    Master and shuffle partitions are set only when given, so a cluster submit keeps its own.
    AQE stays on so that skewed joins are split and small shuffles coalesced at runtime;
    the UI is off (no server is opened).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("KDFRAME_DRIVER_MEMORY", _default_driver_memory()))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024)))
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is only read
    here.  Only a local-mode session without one (tests, the smoke check) gets a fresh
    folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current:
            sc.setCheckpointDir(current)
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    key = sc.applicationId
    if key not in _LOCAL_CKPT:
        _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="kdframe-ckpt-")
    sc.setCheckpointDir(_LOCAL_CKPT[key])
    return _LOCAL_CKPT[key]


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again: later reads neither
    repeat the work above it nor depend on one executor."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
