"""Session helpers.

The library never hard-codes cluster settings.  ``get_spark`` is for tests,
the bench and local runs; on a cluster the caller passes its own session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every job in this package.
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A repeated parameter name keeps the last value
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # graph loops checkpoint every few levels; files of levels no longer
    # referenced are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "credsight") -> SparkSession:
    master = master or os.environ.get("CREDSIGHT_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("CREDSIGHT_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_settings(spark)
    return spark


def ensure_session_settings(spark: SparkSession) -> None:
    """Apply the SQL settings the operators rely on (idempotent)."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Where
    neither is set, a local master -- tests -- gets a scratch folder; on a
    cluster executors could not read each other's files there, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="credsight-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Materialise once as Parquet in the shared checkpoint folder and read it
    back: the lineage is cut, later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{SCRATCH}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: folders that the library writes below the shared checkpoint folder
SCRATCH, STREAMS = "credsight-tables", "credsight-streams"


def clean_up(spark: SparkSession, streams: bool = False, also: tuple[str, ...] = ()) -> list[str]:
    """Remove the tables that :func:`stored` left, with ``streams`` also the
    offsets, state and output of all streams, and the folders named in ``also``.  Frames that still read them become
    unreadable, so call it when their results are written.  Returns the folders removed."""
    base = checkpoint_dir(spark).rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for name in (SCRATCH, *([STREAMS] if streams else []), *also):
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no folder directly below the checkpoint folder")
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if path.getFileSystem(conf).delete(path, True):
            gone.append(name)
    return gone
