"""Gap-safe imputation with masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import roles
from tidegrid.functions.columns import false_if_null
from tidegrid.operators.missing import long_null_runs
from tidegrid.plans.blocks import positions, rolling, running
from tidegrid.plans.quantiles import wide_quantiles
from tidegrid.plans.series import MICROS, Series, attach, micros

# Longest fillable gap in hours.
MAX_GAP_HOURS = 4.0


def interpolate_time(df: DataFrame, s: Series, columns: Sequence[str], limit: int) -> DataFrame:
    """Linear in time between known values, at most ``limit`` rows from either of them; edges copy the nearest value."""
    d = df if s.step else positions(df, s, "__pos")
    at = micros(s.ts)
    place = (at / F.lit(s.step * MICROS)).cast("double") if s.step else F.col("__pos").cast("double")
    known = {
        c: F.when(F.col(c).isNotNull(), F.struct(at.alias("t"), place.alias("p"), F.col(c).cast("double").alias("v")))
        for c in columns
    }
    d = running(d, s, {f"__a_{c}": ("max", k) for c, k in known.items()}, {f"__z_{c}": ("min", k) for c, k in known.items()})
    out = {}
    for c in columns:
        a, z = F.col(f"__a_{c}"), F.col(f"__z_{c}")
        line = a["v"] + (z["v"] - a["v"]) * (at - a["t"]) / (z["t"] - a["t"])
        value = F.when(a.isNull(), z["v"]).when(z.isNull(), a["v"]).otherwise(line)
        near = false_if_null(F.round(place - a["p"]) <= limit) | false_if_null(F.round(z["p"] - place) <= limit)
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(near, value)
    d = d.withColumns(out)
    return d.drop("__pos", *[f"__{p}_{c}" for c in columns for p in "az"])


def fill_steps(df: DataFrame, s: Series, columns: Sequence[str], limit: int) -> DataFrame:
    """Forward fill at most ``limit`` rows, then backward fill at most ``limit`` rows."""
    return rolling(
        df, s, limit, limit,
        lambda w: {f"__f_{c}": F.last(c, True).over(w.rowsBetween(-limit, 0)) for c in columns},
        lambda w: {c: F.first(f"__f_{c}", True).over(w.rowsBetween(0, limit)) for c in columns},
    ).drop(*[f"__f_{c}" for c in columns])


def restore_long_gaps(df: DataFrame, columns: Sequence[str], suffix: str = "_long_gap") -> DataFrame:
    """Back to NULL where the original run was too long."""
    return df.withColumns({c: F.when(~F.col(f"{c}{suffix}"), F.col(c)) for c in columns})


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_masks(df: DataFrame, columns: Sequence[str], prefix: str = "__raw_") -> DataFrame:
    """``<col>_is_interpolated``: was NULL, now is not."""
    return df.withColumns({f"{c}_is_interpolated": F.isnull(f"{prefix}{c}") & F.col(c).isNotNull() for c in columns})


def gap_safe_fill(
    df: DataFrame, s: Series, columns: Sequence[str], max_gap_hours: float = MAX_GAP_HOURS, null_flags: dict[str, str] | None = None, keep_gaps: bool = True
) -> DataFrame:
    """The cleaning step: sensors interpolated, step columns forward filled, long gaps kept as NULL, masks added.

    ``null_flags`` maps columns to hard-outlier flags whose rows are set to NULL
    first; ``keep_gaps=False`` drops rows that still lack a value.
    """
    limit = int(max_gap_hours * 3600 / s.step)
    d = df
    for c, flag in (null_flags or {}).items():
        d = d.withColumn(c, F.when(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)), F.col(c)))
    d = d.withColumns({f"__raw_{c}": F.col(c) for c in columns})
    d = long_null_runs(d, s, columns, limit)
    steps = [c for c in columns if roles.fill_role(c) == "step"]
    sensors = [c for c in columns if c not in steps]
    if sensors:
        d = interpolate_time(d, s, sensors, limit)
    if steps:
        d = fill_steps(d, s, steps, limit)
    d = fill_masks(restore_long_gaps(d, columns), columns)
    d = d.drop(*[f"__raw_{c}" for c in columns], *[f"{c}_long_gap" for c in columns])
    return d if keep_gaps else drop_incomplete(d, columns)


def fill_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str], limit: int) -> DataFrame:
    """Points filled, method and limit per column."""
    one = df.groupBy(*keys).agg(*[F.count_if(f"{c}_is_interpolated").alias(c) for c in columns])
    long = one.unpivot(list(keys), list(columns), "variable", "points_filled")
    method = F.when(F.col("variable").isin([c for c in columns if roles.fill_role(c) == "step"]), "forward_fill")
    return long.withColumns({"method": method.otherwise("linear_time"), "limit_rows": F.lit(limit)})


def median_impute(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULLs to the exact median of their column and key."""
    q = wide_quantiles(df, keys, columns, [0.5], lambda c, _: f"__m_{c}")
    d = attach(df, q, list(keys))
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in columns}).drop(*[f"__m_{c}" for c in columns])
