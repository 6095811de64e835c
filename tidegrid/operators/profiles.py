"""Weekly and hourly load profiles and setpoint tracking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.columns import false_if_null, ratio
from tidegrid.plans.blocks import rolling, running
from tidegrid.plans.quantiles import VALUE, VARIABLE, long_quantiles, melt
from tidegrid.plans.series import Series

# Cells of a week, the count that makes a cell reliable, month orders and core winter months.
WEEK_CELLS, RELIABLE = 168, 5
SUMMER_ORDER = (4, 5, 6, 7, 8, 9, 10)
WINTER_ORDER = (10, 11, 12, 1, 2, 3, 4)
CORE_WINTER = (11, 12, 1, 2, 3)
TOLERANCE = 0.5


def _clocked(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    t = F.col(s.ts)
    return melt(df, [*s.keys, s.ts], columns).withColumns({"weekday": F.weekday(t), "hour": F.hour(t)})


def weekly_aggregates(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Mean, median, standard deviation and count per weekday and hour."""
    by = [*s.keys, VARIABLE, "weekday", "hour"]
    d = _clocked(df, s, columns)
    m = d.groupBy(*by).agg(F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("std"), F.count(VALUE).alias("count"))
    q = long_quantiles(d, by, [0.5]).select(*by, F.col("q")[0].alias("median"))
    return m.join(q, by, "left")


def week_features(df: DataFrame, ts: str) -> DataFrame:
    """ISO week, label from the ISO year, and Monday of the week."""
    t = F.col(ts)
    year, week = F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t)
    return df.withColumns({
        "iso_week": week, "year_week": F.concat(year.cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")),
        "week_start": F.to_date(F.date_trunc("week", t)),
    })


def stacked_weeks(df: DataFrame, s: Series, column: str) -> DataFrame:
    """Mean per week, weekday and hour in long form."""
    d = week_features(df, s.ts).withColumns({"weekday": F.weekday(F.col(s.ts)), "hour": F.hour(s.ts)})
    return d.groupBy(*s.keys, "year_week", "weekday", "hour").agg(F.avg(column).alias("mean"))


def stacked_weeks_wide(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per week and hour, one column per weekday."""
    return long.groupBy(*keys, "year_week", "hour").agg(*[F.max(F.when(F.col("weekday") == d, F.col("mean"))).alias(f"d{d}") for d in range(7)])


def weekend_curve(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Hourly mean for weekdays and weekends."""
    d = _clocked(df, s, columns)
    return d.groupBy(*s.keys, VARIABLE, "hour", (F.col("weekday") >= 5).alias("is_weekend")).agg(F.avg(VALUE).alias("mean"))


def monthly_curves(df: DataFrame, s: Series, column: str) -> DataFrame:
    """Hourly mean per month with the most frequent year and the position of the month in its season."""
    t = F.col(s.ts)
    d = df.select(*s.keys, F.month(t).alias("month"), F.year(t).alias("year"), F.hour(t).alias("hour"), F.col(column).alias(VALUE))
    per_year = d.groupBy(*s.keys, "month", "hour", "year").agg(F.sum(VALUE).alias("sum"), F.count(VALUE).alias("n"), F.count(F.lit(1)).alias("rows"))
    curve = per_year.groupBy(*s.keys, "month", "hour").agg(ratio(F.sum("sum"), F.sum("n")).alias("mean"))
    rows = per_year.groupBy(*s.keys, "month", "year").agg(F.sum("rows").alias("rows"))
    years = rows.groupBy(*s.keys, "month").agg(F.max_by("year", F.struct("rows", -F.col("year"))).alias("year"))
    season = years.groupBy(*s.keys).agg(F.when(F.max(F.col("month").isin(*CORE_WINTER)), "winter").otherwise("summer").alias("season"))
    pos = lambda order: F.array_position(F.array(*[F.lit(m) for m in order]), F.col("month"))
    years = years.join(season, list(s.keys)) if s.keys else years.withColumn("season", season.scalar())
    years = years.withColumn("month_order", F.when(F.col("season") == "winter", pos(WINTER_ORDER)).otherwise(pos(SUMMER_ORDER)))
    return curve.join(years, [*s.keys, "month"])


def weekly_kpis(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Peak hour, peak to valley ratio, weekday minus weekend, and share of week cells with few values."""
    by = [*s.keys, VARIABLE]
    cells = _clocked(df, s, columns).groupBy(*by, "weekday", "hour").agg(F.sum(VALUE).alias("sum"), F.count(VALUE).alias("n"))
    end = F.col("weekday") >= 5
    mean = lambda p: ratio(F.sum(F.when(p, F.col("sum"))), F.sum(F.when(p, F.col("n"))))
    hours = cells.groupBy(*by, "hour").agg(mean(~end).alias("wd"), mean(end).alias("we"))
    k = hours.groupBy(*by).agg(
        F.max_by("hour", F.when(F.col("wd").isNotNull(), F.struct("wd", -F.col("hour")))).alias("peak_hour"),
        (F.max("wd") / F.when(F.min("wd") > 0, F.min("wd"))).alias("peak_valley_ratio"),
        F.avg(F.col("wd") - F.col("we")).alias("weekday_weekend_delta"))
    low = cells.groupBy(*by).agg((100.0 * F.count_if(F.col("n") < RELIABLE) / WEEK_CELLS).alias("low_count_pct"))
    return k.join(low, by)


def daily_bands(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Per weekday and hour the minimum, mean and maximum over dates of the hourly means."""
    by = [*s.keys, VARIABLE, "weekday", "hour"]
    d = _clocked(df, s, columns).withColumn("date", F.to_date(s.ts))
    d = d.groupBy(*by, "date").agg(F.avg(VALUE).alias("m"))
    return d.groupBy(*by).agg(F.min("m").alias("low"), F.avg("m").alias("mean"), F.max("m").alias("high"))


def season_profiles(df: DataFrame, s: Series, season: str, columns: Sequence[str]) -> DataFrame:
    """Hourly mean per season (``weekday`` NULL) and per season and weekday, from one aggregation of cells."""
    d = melt(df, [*s.keys, season, s.ts], columns).withColumns({"weekday": F.weekday(F.col(s.ts)), "hour": F.hour(s.ts)})
    by = [*s.keys, season, VARIABLE, "hour"]
    cells = d.groupBy(*by, "weekday").agg(F.sum(VALUE).alias("sum"), F.count(VALUE).alias("n"))
    mean = ratio(F.sum("sum"), F.sum("n"))
    day = cells.groupBy(*by, "weekday").agg(mean.alias("mean"))
    return day.unionByName(cells.groupBy(*by).agg(mean.alias("mean")).withColumn("weekday", F.lit(None).cast("int")))


def setpoint_kpis(df: DataFrame, keys: Sequence[str], measured: str, setpoint: str, tolerance: float = TOLERANCE) -> DataFrame:
    """MAE, RMSE, bias, spread, time in band, over and undershoot; unknown errors count as outside the band."""
    e = F.col(measured) - F.col(setpoint)
    pct = lambda p: 100.0 * F.avg(false_if_null(p).cast("int"))
    return df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("std_dev"),
        pct(F.abs(e) <= tolerance).alias("time_in_band_pct"), pct(e > tolerance).alias("overshoot_pct"),
        pct(e < -tolerance).alias("undershoot_pct"), F.count(e).alias("count"))


def centred(n: int) -> tuple[int, int]:
    """Rows before and after for a centred window of ``n`` rows."""
    after = (n - 1) // 2
    return n - 1 - after, after


def smoothed_pair(df: DataFrame, s: Series, measured: str, setpoint: str, window: int = 1) -> DataFrame:
    """Setpoint carried forward, then a centred mean of both signals."""
    known = F.when(F.col(setpoint).isNotNull(), F.struct(F.col(s.ts).alias("t"), F.col(setpoint).alias("v")))
    d = running(df.select(*s.keys, s.ts, measured, setpoint), s, {"__sp": ("max", known)})
    d = d.withColumn(setpoint, F.col("__sp.v")).drop("__sp")
    if window <= 1:
        return d
    before, after = centred(window)
    return rolling(d, s, before, after, lambda w: {
        f"__{c}": F.avg(c).over(w.rowsBetween(-before, after)) for c in (measured, setpoint)
    }).select(*s.keys, s.ts, *[F.col(f"__{c}").alias(c) for c in (measured, setpoint)])


def season_pair(season: str, cooling: str | None, heating: str | None, columns: Sequence[str]) -> str | None:
    """Setpoint column of the season, the other one if it is absent."""
    order = (cooling, heating) if season == "summer" else (heating, cooling)
    return next((c for c in order if c and c in columns), None)


def pair_kpis(df: DataFrame, s: Series, measured: str, setpoint: str, window: int = 2, tolerance: float = TOLERANCE) -> DataFrame:
    return setpoint_kpis(smoothed_pair(df, s, measured, setpoint, window), s.keys, measured, setpoint, tolerance)


def operation_view(df: DataFrame, s: Series, signals: Sequence[str], fans: Sequence[str], start: str, end: str) -> DataFrame:
    """Signals over a date range with fan modulation in percent."""
    from tidegrid.functions.columns import between_dates
    from tidegrid.operators.clean import percent_scale

    d = percent_scale(df.select(*s.keys, s.ts, *signals, *fans), s.keys, fans)
    return d.filter(between_dates(s.ts, start, end))
