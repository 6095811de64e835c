"""The resample on unbounded input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample_stream(stream: DataFrame, keys: Sequence[str], ts: str, step_s: int, aggs: Mapping[str, Column], lateness: str = "10 minutes") -> DataFrame:
    """Aggregates per bin; a bin is emitted once the watermark passes its end, later rows are dropped."""
    d = stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, f"{step_s} seconds").alias("__w"))
    return d.agg(*[a.alias(n) for n, a in aggs.items()]).select(*keys, F.col("__w.start").alias(ts), *aggs)
