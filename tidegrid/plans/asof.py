"""As-of and range joins as ordered unions and bucketed equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.plans.blocks import running
from tidegrid.plans.series import MICROS, Series, floor_div, micros


def asof(
    left: DataFrame,
    right: DataFrame,
    s: Series,
    values: Sequence[str],
    direction: str = "backward",
    tolerance_s: float | None = None,
    matched: str | None = None,
) -> DataFrame:
    """Left rows with ``values`` of the nearest right row before, after, or on either side.

    Both sides go through one shuffle by (keys, time block); the candidate from
    earlier blocks arrives with the per-block totals.  Ties of ``nearest`` go to
    the earlier row.  ``right`` has unique timestamps per key; NULL values of the
    matched row are kept.  ``matched`` names an output column for its timestamp.
    """
    cols = [c for c in left.columns if c not in (*s.keys, s.ts)]
    payload = F.struct(F.col(s.ts).alias("__at"), *[F.col(v) for v in values])
    lt = left.select(*s.keys, s.ts, F.lit(1).alias("__side"), F.struct(F.lit(1).alias("__x"), *cols).alias("__left"))
    rt = right.select(*s.keys, s.ts, F.lit(0).alias("__side"), payload.alias("__right"))
    d = lt.unionByName(rt, allowMissingColumns=True).withColumn("__fside", 1 - F.col("__side"))
    need_back, need_ahead = direction in ("backward", "nearest"), direction in ("forward", "nearest")
    d = running(
        d, Series(s.keys, s.ts, None, ("__side",), s.span),
        {"__b": ("max", F.col("__right"))} if need_back else {},
        {"__f": ("min", F.col("__right"))} if need_ahead else {},
        backward_tie=("__fside",),
    )
    d = d.filter(F.col("__side") == 1)
    gap = lambda c: F.abs(micros(F.col(c)["__at"]) - micros(s.ts))
    if direction == "nearest":
        hit = F.when(F.col("__f").isNull() | (gap("__b") <= gap("__f")), F.col("__b")).otherwise(F.col("__f"))
    else:
        hit = F.col("__b") if need_back else F.col("__f")
    d = d.withColumn("__hit", hit)
    if tolerance_s is not None:
        d = d.withColumn("__hit", F.when(gap("__hit") <= int(tolerance_s * MICROS), F.col("__hit")))
    extra = [F.col("__hit")["__at"].alias(matched)] if matched else []
    return d.select(
        *s.keys, s.ts, *[F.col("__left")[c].alias(c) for c in cols],
        *[F.col("__hit")[v].alias(v) for v in values], *extra,
    )


def within(anchors: DataFrame, rows: DataFrame, s: Series, before_s: float, after_s: float, anchor_ts: str) -> DataFrame:
    """Pairs of anchors and rows with ``anchor - before <= ts <= anchor + after``.

    Each anchor is copied to the few time buckets its interval touches, so the
    join is an equi join on (keys, bucket).
    """
    width = max(int((before_s + after_s) * MICROS), MICROS)
    at = micros(anchor_ts)
    lo, hi = at - int(before_s * MICROS), at + int(after_s * MICROS)
    a = anchors.withColumn("__bucket", F.explode(F.sequence(floor_div(lo, width), floor_div(hi, width))))
    r = rows.withColumn("__bucket", floor_div(micros(s.ts), width))
    j = a.join(r, [*s.keys, "__bucket"])
    return j.filter(micros(s.ts).between(lo, hi)).drop("__bucket")
