"""Resampling and regular grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import roles
from tidegrid.plans.asof import asof
from tidegrid.plans.quantiles import wide_quantiles
from tidegrid.plans.series import BLOCK_ROWS, MICROS, Series, micros


def timeline(bounds: DataFrame, keys: Sequence[str], lo: str, hi: str, step_s: int, out: str = "ts") -> DataFrame:
    """Every stamp from ``lo`` to ``hi`` (inclusive) per key.

    Stamps are made in two steps, blocks first, spread over tasks, then the
    stamps of a block, so a long series is not expanded by one task.
    """
    kind = dict(bounds.dtypes)[lo]
    n = F.floor((micros(hi) - micros(lo)) / (step_s * MICROS))
    d = bounds.select(*keys, micros(lo).alias("__lo"), n.alias("__n"))
    d = d.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__n") / BLOCK_ROWS))))
    d = d.repartition(*keys, "__b")
    first = F.col("__b") * BLOCK_ROWS
    d = d.withColumn("__i", F.explode(F.sequence(first, F.least(first + BLOCK_ROWS - 1, F.col("__n")))))
    stamp = F.timestamp_micros(F.col("__lo") + F.col("__i") * (step_s * MICROS)).cast(kind)
    return d.select(*keys, stamp.alias(out))


def regular_grid(df: DataFrame, s: Series, step_s: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Full timeline min..max per key; missing stamps become NULL rows, off-grid rows vanish."""
    cols = list(columns or [c for c in df.columns if c not in (*s.keys, s.ts)])
    bounds = df.groupBy(*s.keys).agg(F.min(s.ts).alias("__min"), F.max(s.ts).alias("__max"))
    line = timeline(bounds, s.keys, "__min", "__max", step_s, s.ts)
    return line.join(df.select(*s.keys, s.ts, *cols), [*s.keys, s.ts], "left")


def missing_timestamp_rate(df: DataFrame, s: Series, step_s: int) -> DataFrame:
    """Per key: expected stamps, present stamps and the missing share, without building the grid."""
    at = micros(s.ts)
    b = df.groupBy(*s.keys).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    step = step_s * MICROS
    per = df.select(*s.keys, at.alias("__at"))
    if s.keys:
        per = per.join(b, list(s.keys))
    else:
        per = per.withColumn("__b", b.select(F.struct("__lo", "__hi")).scalar()).select("__at", "__b.*")
    on_grid = F.when((F.col("__at") - F.col("__lo")) % step == 0, F.col("__at"))
    d = per.groupBy(*s.keys).agg(
        F.max(F.floor((F.col("__hi") - F.col("__lo")) / step) + 1).alias("expected"),
        F.count_distinct(on_grid).alias("present"),
    )
    return d.withColumn("missing_rate", 100.0 * (F.col("expected") - F.col("present")) / F.col("expected"))


def bin_start(ts: str, step_s: int) -> Column:
    return F.window(ts, f"{step_s} seconds")["start"]


def resample(df: DataFrame, s: Series, step_s: int, aggs: Mapping[str, Column]) -> DataFrame:
    """Aggregates per bin; partial aggregation runs before the shuffle."""
    d = df.groupBy(*s.keys, F.window(s.ts, f"{step_s} seconds").alias("__w")).agg(
        *[a.alias(n) for n, a in aggs.items()]
    )
    return d.select(*s.keys, F.col("__w.start").alias(s.ts), *aggs)


def resample_mean(df: DataFrame, s: Series, step_s: int, columns: Sequence[str]) -> DataFrame:
    """Bin means on the full grid; empty bins are NULL rows."""
    d = resample(df, s, step_s, {c: F.avg(c) for c in columns})
    return regular_grid(d, s, step_s, columns)


def role_resample(df: DataFrame, s: Series, step_s: int, columns: Sequence[str], step_columns: Sequence[str] | None = None) -> DataFrame:
    """Sensors: bin mean.  Step columns: value of the last raw row at or before the bin start, NULL included."""
    stepped = [c for c in columns if (c in step_columns if step_columns is not None else roles.is_step(c))]
    sensors = [c for c in columns if c not in stepped]
    d = resample(df, s, step_s, {**{c: F.avg(c) for c in sensors}, "__n": F.count(F.lit(1))})
    d = regular_grid(d, s, step_s, sensors)
    if stepped:
        # rows of one stamp: the last one by the tie columns counts
        values = F.struct(*stepped)
        last = F.max_by(values, F.struct(*s.tie)) if s.tie else F.last(values)
        raw = df.groupBy(*s.keys, s.ts).agg(last.alias("__v")).select(*s.keys, s.ts, *[F.col(f"__v.{c}").alias(c) for c in stepped])
        d = asof(d, raw, s, stepped)
    return d.select(*s.keys, s.ts, *columns)


def aggregate_time(df: DataFrame, s: Series, unit: str, columns: Sequence[str], how: str = "mean", keep: Column | None = None) -> DataFrame:
    """Mean or median per hour or day; optional row filter; bins without any value are dropped."""
    d = (df if keep is None else df.filter(keep)).withColumn("__bin", F.date_trunc(unit, s.ts))
    if how == "median":
        out = wide_quantiles(d, [*s.keys, "__bin"], columns, [0.5], lambda c, _: c)
    else:
        out = d.groupBy(*s.keys, "__bin").agg(*[F.avg(c).alias(c) for c in columns])
    some = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    kind = dict(df.dtypes)[s.ts]
    return out.filter(some).select(*s.keys, F.col("__bin").cast(kind).alias(s.ts), *columns)


def role_aggregate(df: DataFrame, s: Series, unit: str, columns: Sequence[str]) -> DataFrame:
    """Per bin: median of step-like columns, mean of sensors, chosen by column name."""
    step_like = [c for c in columns if roles.is_step(c)]
    sensors = [c for c in columns if c not in step_like]
    parts = [aggregate_time(df, s, unit, cols, how) for cols, how in ((sensors, "mean"), (step_like, "median")) if cols]
    out = parts[0] if len(parts) == 1 else parts[0].join(parts[1], [*s.keys, s.ts], "full")
    return out.select(*s.keys, s.ts, *columns)


def daily_mean(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*s.keys, F.to_date(s.ts).alias("date")).agg(*[F.avg(c).alias(c) for c in columns])


def carpet(df: DataFrame, s: Series, column: str) -> DataFrame:
    """``date, hour, value`` over all days x 24 hours; median for step-like columns, else mean."""
    d = df.select(*s.keys, F.to_date(s.ts).alias("date"), F.hour(s.ts).alias("hour"), F.col(column).alias("value"))
    if roles.is_step(column):
        cells = wide_quantiles(d, [*s.keys, "date", "hour"], ["value"], [0.5], lambda *_: "value")
    else:
        cells = d.groupBy(*s.keys, "date", "hour").agg(F.avg("value").alias("value"))
    days = d.groupBy(*s.keys).agg(
        F.min("date").cast("timestamp").alias("__lo"),
        (F.max("date").cast("timestamp") + F.expr("INTERVAL 23 HOURS")).alias("__hi"),
    )
    line = timeline(days, s.keys, "__lo", "__hi", 3600, "__t")
    line = line.select(*s.keys, F.to_date("__t").alias("date"), F.hour("__t").alias("hour"))
    return line.join(cells, [*s.keys, "date", "hour"], "left")


def coverage(cells: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """Share of grid cells with a value."""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), (100.0 * F.count(column) / F.count(F.lit(1))).alias("coverage_pct")
    )
