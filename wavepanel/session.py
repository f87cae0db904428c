"""Session construction and lineage cutting.

The shared checkpoint folder comes from ``spark.checkpoint.dir``. A session
without one gets a scratch folder only if it runs in a single process; on a
cluster that would be the driver's own disk, so there it is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "wavepanel") -> SparkSession:
    """Session tuned for this library: AQE on, UI off, UTC, Arrow on.

    ``partitions`` sets ``spark.sql.shuffle.partitions``; AQE coalesces the
    small post-aggregation stages, so a value sized for the big shuffles is
    right (about 2-3x total cores, or input bytes / 128 MB at scale).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder, creating a scratch one
    only when none is configured and the session is a single process."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="wavepanel-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives lost
    executors, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back:
    what follows survives lost executors, and reads the columns it needs."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
