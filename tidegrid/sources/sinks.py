"""Table, summary and run-registry writers.

A table is written whole beside its place and then takes it, so a job that fails
leaves the table as it was. The registry replaces the rows of one version at a
time, so a run that is logged again, after a failure or not, is there once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    """DOUBLE columns rounded half up."""
    cols = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a complete folder in the place of another; what was there goes when the new one stands."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, own, old = hadoop.Path(staged), hadoop.Path(path), hadoop.Path(f"{staged}-old")
    fs = own.getFileSystem(conf)
    if fs.exists(own) and not fs.rename(own, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, own):
        fs.rename(old, own)
        raise OSError(f"{staged} can't take the place of {path}")
    fs.delete(old, True)


def _write(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] = (), **options) -> None:
    staged = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.format(fmt).save(staged)
    except Exception:
        spark = df.sparkSession
        left = spark._jvm.org.apache.hadoop.fs.Path(staged)
        left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)
        raise
    _replace(df.sparkSession, staged, path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), digits: int | None = None) -> None:
    """Overwrite a table; ``digits`` writes the rounded form."""
    out = rounded(df, digits) if digits is not None else df
    _write(out, path, fmt, partition_by, **({"header": True} if fmt == "csv" else {}))


def write_full_and_rounded(df: DataFrame, path: str, digits: int = 2, fmt: str = "parquet") -> None:
    write_table(df, f"{path}/full", fmt)
    write_table(df, f"{path}/rounded", fmt, digits=digits)


def write_summary(summary: DataFrame, path: str) -> None:
    """A run summary as JSON lines, missing values as nulls."""
    _write(summary, path, "json", ignoreNullFields=False)


def run_record(metrics: DataFrame, version: str, config: Mapping) -> DataFrame:
    """One registry row per metrics row: version, config as JSON and the metrics."""
    return metrics.select(
        F.lit(version).alias("version"), F.lit(json.dumps(dict(config), sort_keys=True)).alias("config"), "*"
    )


def log_run(record: DataFrame, path: str) -> None:
    """Put the rows of a run's version into the registry table, with the time of logging, in place of earlier rows of that version."""
    d = record.withColumns({"logged_at": F.current_timestamp(), "run": F.col("version")})
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the registry; versions are text as they were logged."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("run")
