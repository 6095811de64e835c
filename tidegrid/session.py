"""Session defaults and durable materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew-join handling and a UTC clock.

    Cluster sizing (executors, memory, shuffle partitions) is left to the
    submitter unless given here.
    """
    builder = (
        SparkSession.builder.appName("tidegrid")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Stage tables written by this process and not removed yet.
_STAGES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set as the checkpoint folder; a fresh local one only where the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidegrid-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named


def stage_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``remove_stages`` deletes."""
    _STAGES.append(f"{shared_folder(spark).rstrip('/')}/tidegrid-{uuid.uuid4().hex}")
    return _STAGES[-1]


def durable(df: DataFrame) -> DataFrame:
    """Store an intermediate table in the shared folder and read it back.

    Cuts lineage like a reliable checkpoint and survives lost executors, and as a
    columnar table it keeps column pruning and exact sizes for later joins.
    ``remove_stages`` deletes the tables once the results that read them are stored.
    """
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession) -> int:
    """Delete all stage tables that this process wrote, and return their number. Results that are not stored yet can't be read afterwards."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    n = len(_STAGES)
    while _STAGES:
        path = hadoop.Path(_STAGES.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
