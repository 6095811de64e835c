"""Joins of series with weather, flags, rule inputs and context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.plans.asof import asof, within
from tidegrid.plans.blocks import rolling, running
from tidegrid.plans.series import MICROS, Series, micros

# Fixed value: share of exact matches above which no tolerance join is needed.
EXACT_ENOUGH = 80.0


def exact_join(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join on exact stamps with a ``matched`` flag; a small side is broadcast by the adaptive planner."""
    r = right.select(*on, *values, F.lit(True).alias("matched"))
    return left.join(r, list(on), "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def match_rate(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), (100.0 * F.avg(F.col("matched").cast("int"))).alias("match_rate")
    )


def nearest_join(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], tolerance_s: float) -> DataFrame:
    return asof(left, right, s, values, "nearest", tolerance_s)


def two_step_join(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str], tolerance_s: float, accept: float = EXACT_ENOUGH) -> DataFrame:
    """Exact match; where a key's match rate is at most ``accept`` %, the nearest row within the tolerance.

    One plan serves both: the nearest row of an exact match is the match itself.
    """
    d = asof(left, right, s, values, "nearest", tolerance_s, matched="__at")
    exact = F.coalesce(F.col("__at") == F.col(s.ts), F.lit(False))
    d = d.withColumn("__exact", exact)
    rate = d.groupBy(*s.keys).agg((100.0 * F.avg(F.col("__exact").cast("int"))).alias("__rate"))
    if s.keys:
        d = d.join(rate, list(s.keys))
    else:
        d = d.withColumn("__rate", rate.scalar())
    keep = F.col("__exact") | (F.col("__rate") <= accept)
    return d.withColumns({v: F.when(keep, F.col(v)) for v in values}).drop("__at", "__exact", "__rate")


def align_flags(df: DataFrame, flags: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Flags beside the data rows; rows without flags get 0."""
    d = df.join(flags.select(*on, *columns), list(on), "left")
    return d.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns})


def backward_lookup(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str]) -> DataFrame:
    return asof(left, right, s, values, "backward")


def fill_both_ways(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Last known value, else the next known one."""
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(s.ts), F.col(c))) for c in columns}
    d = running(df, s, {f"__b_{c}": ("max", k) for c, k in known.items()}, {f"__f_{c}": ("min", k) for c, k in known.items()})
    d = d.withColumns({c: F.coalesce(F.col(f"__b_{c}")[c], F.col(f"__f_{c}")[c]) for c in columns})
    return d.drop(*[f"__{p}_{c}" for c in columns for p in "bf"])


def lookup_filled(left: DataFrame, right: DataFrame, s: Series, values: Sequence[str]) -> DataFrame:
    """Exact lookup on the left stamps, holes filled from the neighbours on both sides."""
    return fill_both_ways(left.join(right.select(*s.keys, s.ts, *values), [*s.keys, s.ts], "left"), s, values)


def context(anchors: DataFrame, rows: DataFrame, s: Series, reach_s: float, anchor_ts: str = "anchor_ts") -> DataFrame:
    """Rows within ``reach_s`` seconds of each anchor."""
    return within(anchors, rows, s, reach_s, reach_s, anchor_ts)


def near_boundary(rows: DataFrame, boundaries: DataFrame, s: Series, reach_s: float, boundary_ts: str = "boundary_ts") -> DataFrame:
    """Flag rows with a boundary within ``reach_s`` seconds, by the nearest boundary on either side."""
    b = boundaries.select(*s.keys, F.col(boundary_ts).alias(s.ts), F.lit(True).alias("__hit")).distinct()
    d = asof(rows, b, s, ["__hit"], "nearest", reach_s)
    return d.withColumn("near_gap", F.coalesce("__hit", F.lit(False))).drop("__hit")


def in_set(rows: DataFrame, stamps: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """Flag rows whose stamp is in a set of stamps."""
    d = stamps.select(*on).distinct().withColumn(out, F.lit(True))
    return rows.join(d, list(on), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def common_index(df: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """Stamps at which all columns of one table have a value: a filter, for the columns share their rows."""
    return df.select(ts, *columns).dropna(subset=list(columns))


def holiday_mask(df: DataFrame, ts: str, holidays: DataFrame, date: str, occupied: str) -> DataFrame:
    """``is_holiday`` by date; ``occupied`` becomes 0 on holidays."""
    h = holidays.select(F.to_date(date).alias("__d"), F.lit(True).alias("is_holiday")).distinct()
    d = df.withColumn("__d", F.to_date(ts)).join(h, "__d", "left").drop("__d")
    d = d.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))
    return d.withColumn(occupied, F.when(F.col("is_holiday"), 0).otherwise(F.col(occupied)))


def one_period_back(df: DataFrame, s: Series, period_s: int, tol_s: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of the rows seen ``period ± tol`` seconds earlier: a bounded time frame, no self join and no list of its values in a row."""
    def frame(w):
        at = F.floor(micros(s.ts) / MICROS)
        r = w.orderBy(at).rangeBetween(-(period_s + tol_s), -(period_s - tol_s))
        return {n: c.over(r) for n, c in aggregates.items()}

    return rolling(df, s, period_s + tol_s, 0, frame, in_seconds=True)
