"""Missing data: rates, periods, episodes, shutdowns and quality checks.

Per-column work runs once over the long form ``keys, ts, variable, value``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.columns import ladder, ladder_above, ratio
from tidegrid.plans.blocks import episodes, rolling, run_stages, run_starts
from tidegrid.plans.quantiles import VALUE, VARIABLE, melt
from tidegrid.plans.series import MICROS, Series, attach, micros

# Rating and severity ladders, gap-length edges in hours, verdict bounds.
RATINGS = ((1, "Excellent"), (5, "Good"), (15, "Fair"), (30, "Poor"))
SEVERITIES = ((12, "Minor"), (48, "Moderate"), (168, "Major"))
GAP_EDGES_H = (0.5, 1.0, 4.0, 24.0)
GAP_LABELS = ("<30min", "30min-1h", "1-4h", "4-24h", ">24h")
SAFE_H, MEDIUM_H = 4.0, 24.0
VERDICTS = ((90, "safe to interpolate"), (70, "mostly safe"), (50, "review medium gaps"))
LONG_GAP_H, HIGH_MISSING_PCT, MANY_GAPS = 48.0, 30.0, 50
WORKING_HOURS = (8, 17)
CORRELATED, STRONG, VERY_STRONG = 0.5, 0.6, 0.8


def long_series(df: DataFrame, s: Series, columns: Sequence[str]) -> tuple[DataFrame, Series]:
    """Long form and its series, keyed by the column name as well."""
    return melt(df, [*s.keys, s.ts], columns), replace(s, keys=(*s.keys, VARIABLE), tie=())


def hours(a: Column | str, b: Column | str) -> Column:
    return (micros(b) - micros(a)) / F.lit(3600.0 * MICROS)


def missing_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Missing count, share and rating per column."""
    d = melt(df, keys, columns).groupBy(*keys, VARIABLE).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.isnull(VALUE)).alias("missing")
    )
    pct = 100.0 * F.col("missing") / F.col("total")
    return d.withColumn("missing_pct", pct).withColumn("rating", ladder(F.col("missing_pct"), RATINGS, "Critical"))


def missing_periods(df: DataFrame, s: Series, columns: Sequence[str], min_hours: float = 4.0) -> DataFrame:
    """NULL runs of at least ``min_hours``; the end includes one mean step of the series."""
    long, ls = long_series(df, s, columns)
    gaps = episodes(long, ls, F.col(VALUE).isNull())
    at = micros(s.ts)
    step = df.groupBy(*s.keys).agg(
        ((F.max(at) - F.min(at)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("__step")
    )
    d = attach(gaps, step, s.keys)
    end = F.timestamp_micros((micros("end_time") + F.col("__step")).cast("bigint")).cast(dict(df.dtypes)[s.ts])
    d = d.withColumn("end_time", end).withColumn("duration_hours", hours("start_time", "end_time"))
    d = d.filter(F.col("duration_hours") >= min_hours)
    return d.select(
        *ls.keys, "start_time", "end_time", "duration_hours", (F.col("duration_hours") / 24).alias("duration_days"),
        F.col("n_rows").alias("missing_records"), ladder(F.col("duration_hours"), SEVERITIES, "Critical").alias("severity"),
    )


def gap_durations(df: DataFrame, s: Series, columns: Sequence[str], min_hours: float = 0.0) -> DataFrame:
    """NULL runs with their last minus first stamp in hours (one NULL is 0 h)."""
    long, ls = long_series(df, s, columns)
    d = episodes(long, ls, F.col(VALUE).isNull()).withColumn("gap_hours", hours("start_time", "end_time"))
    return d.filter(F.col("gap_hours") >= min_hours)


def gap_histogram(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of gaps per length class (classes are closed on the left)."""
    label = ladder(F.col("gap_hours"), tuple(zip(GAP_EDGES_H, GAP_LABELS)), GAP_LABELS[-1])
    return gaps.groupBy(*keys, label.alias("gap_class")).agg(F.count(F.lit(1)).alias("n_gaps"))


def gap_safety(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares of short, medium and long gaps and the verdict on interpolating them."""
    g = F.col("gap_hours")
    pct = lambda p: 100.0 * F.avg(p.cast("int"))
    d = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.max(g).alias("max_gap_hours"), pct(g <= SAFE_H).alias("safe_pct"),
        pct((g > SAFE_H) & (g <= MEDIUM_H)).alias("medium_pct"), pct(g > MEDIUM_H).alias("long_pct"),
    )
    return d.withColumn("verdict", ladder_above(F.col("safe_pct"), VERDICTS, "many long gaps"))


def missing_timestamps(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """One row per missing cell with its calendar facts."""
    t = F.col(s.ts)
    d = melt(df, [*s.keys, s.ts], columns).filter(F.col(VALUE).isNull())
    return d.select(
        *s.keys, s.ts, VARIABLE, F.to_date(t).alias("date"), F.date_format(t, "HH:mm:ss").alias("time"),
        F.hour(t).alias("hour_of_day"), F.date_format(t, "EEEE").alias("day_of_week"),
        (F.weekday(t) >= 5).alias("is_weekend"), F.hour(t).between(*WORKING_HOURS).alias("is_working_hours"),
    )


def missing_correlations(df: DataFrame, keys: Sequence[str], columns: Sequence[str], limit: float = CORRELATED) -> DataFrame:
    """Pairs of columns whose missing flags correlate beyond the limit."""
    from tidegrid.operators.correlate import pearson_pairs

    flags = df.select(*keys, *[F.isnull(c).cast("double").alias(c) for c in columns])
    d = pearson_pairs(flags, keys, columns).filter(F.abs("r") > limit)
    return d.withColumn("strength", ladder_above(F.col("r"), ((VERY_STRONG, "Very Strong"), (STRONG, "Strong")), "Moderate"))


def sensor_failures(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Failure class of each column with missing data, from its longest gap, missing share and gap count."""
    gaps = gap_durations(df, s, columns).groupBy(*s.keys, VARIABLE).agg(
        F.max("gap_hours").alias("max_gap_hours"), F.count(F.lit(1)).alias("gap_count")
    )
    d = missing_summary(df, s.keys, columns).select(*s.keys, VARIABLE, "missing_pct").join(gaps, [*s.keys, VARIABLE])
    case = lambda a, b, c, other: (
        F.when(F.col("max_gap_hours") > LONG_GAP_H, a).when(F.col("missing_pct") > HIGH_MISSING_PCT, b)
        .when(F.col("gap_count") > MANY_GAPS, c).otherwise(other)
    )
    return d.withColumns({
        "failure_type": case("Sensor failure", "Extensive missing data", "Communication issues", "Normal gaps"),
        "priority": case("High", "Medium", "Medium", "Low"),
    })


def _shutdown_rows(df: DataFrame, columns: Sequence[str], fraction: float) -> tuple[DataFrame, Column]:
    n_null = sum((F.isnull(c).cast("int") for c in columns), F.lit(0))
    return df.withColumn("__nulls", n_null), F.col("__nulls") >= ceil(fraction * len(columns))


def shutdowns(df: DataFrame, s: Series, columns: Sequence[str], fraction: float = 0.8, min_hours: float = 12.0) -> DataFrame:
    """Periods in which most columns are missing together."""
    d, off = _shutdown_rows(df, columns, fraction)
    ep = episodes(d, s, off, [F.min_by("__nulls", s.ts).cast("bigint").alias("columns_missing")])
    ep = ep.withColumn("duration_hours", hours("start_time", "end_time")).filter(F.col("duration_hours") >= min_hours)
    return ep.select(
        *s.keys, "start_time", "end_time", "duration_hours", (F.col("duration_hours") / 24).alias("duration_days"),
        "columns_missing", (100.0 * F.col("columns_missing") / len(columns)).alias("pct_columns"),
    )


def shutdown_flag(df: DataFrame, s: Series, columns: Sequence[str], fraction: float = 0.8, min_hours: float = 12.0, out: str = "system_shutdown_flag") -> DataFrame:
    """Row mask of the shutdown periods; on a grid a bounded look to both sides decides."""
    d, off = _shutdown_rows(df, columns, fraction)
    if s.step:
        n = ceil(min_hours * 3600 / s.step) + 1
        d = rolling(d, s, n - 1, n - 1, *run_stages(s, {out: (off, n)}))
        return d.withColumn(out, F.col(out).cast("int")).drop("__nulls")
    runs = run_starts(d, s, off, "__run")
    keep = runs.groupBy(*s.keys, "__run").agg(F.max(s.ts).alias("__end"))
    keep = keep.filter(hours("__run", "__end") >= min_hours).select(*s.keys, "__run", F.lit(1).alias(out))
    hit = runs.join(keep, [*s.keys, "__run"]).select(*s.keys, s.ts, out)
    return df.join(hit, [*s.keys, s.ts], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing_flag": F.isnull(c).cast("int") for c in columns})


def run_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Overall share of missing cells, rows with any missing value, and missing count per column."""
    total = sum((F.isnull(c).cast("int") for c in columns), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), (100.0 * F.sum(total) / (F.count(F.lit(1)) * len(columns))).alias("nan_rate"),
        F.count_if(total > 0).alias("rows_with_missing"), *[F.count_if(F.isnull(c)).alias(f"{c}_missing") for c in columns],
    )


def missing_by_weekday(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    d = melt(df, [*s.keys, s.ts], columns)
    return d.groupBy(*s.keys, VARIABLE, F.weekday(F.col(s.ts)).alias("weekday")).agg(
        (100.0 * F.avg(F.isnull(VALUE).cast("int"))).alias("missing_pct")
    )


def missing_by_season(df: DataFrame, keys: Sequence[str], season: str, columns: Sequence[str]) -> DataFrame:
    """Missing share per season and column, ordered from most to least missing."""
    d = melt(df, [*keys, season], columns).groupBy(*keys, season, VARIABLE).agg(
        (100.0 * F.avg(F.isnull(VALUE).cast("int"))).alias("missing_pct")
    )
    return d.orderBy(*keys, season, F.desc("missing_pct"), VARIABLE)


def missing_in_one_season(by_season: DataFrame, keys: Sequence[str], season: str) -> DataFrame:
    """Columns with missing data in exactly one season."""
    d = by_season.filter(F.col("missing_pct") > 0).groupBy(*keys, VARIABLE)
    return d.agg(F.count(F.lit(1)).alias("n"), F.min(season).alias("only_season")).filter("n = 1").drop("n")


def cross_column_gaps(df: DataFrame, s: Series, columns: Sequence[str], max_gap_s: float) -> DataFrame:
    """Gap list: per column, NULL runs whose first NULL to first valid row after lasts more than the limit."""
    long, ls = long_series(df, s, columns)
    t = F.col(s.ts)
    look = lambda w: {"__before": F.lag(t).over(w), "__next": F.lead(t).over(w), "__after": F.lead(t, 2).over(w)}
    d = rolling(long, ls.with_step(None), 1, 2, look)
    last = lambda c: F.max_by(c, s.ts)
    ep = episodes(d, ls, F.col(VALUE).isNull(), [
        F.min_by("__before", s.ts).alias("row_before"), last("__next").alias("next_valid"), last("__after").alias("row_after")])
    end = F.coalesce("next_valid", "end_time")
    ep = ep.withColumn("gap_end", end).withColumn("duration_hours", hours("start_time", "gap_end"))
    return ep.filter(F.col("duration_hours") * 3600 > max_gap_s).select(
        *ls.keys, "start_time", "gap_end", "duration_hours", "row_before", F.when(F.col("next_valid").isNotNull(), F.col("row_after")).alias("row_after"))


def boundary_rows(df: DataFrame, s: Series, columns: Sequence[str], max_gap_s: float, out: str = "is_boundary") -> DataFrame:
    """Rows at the edges of any column's long gap, and both rows of a large time jump."""
    gaps = cross_column_gaps(df, s, columns, max_gap_s)
    edges = gaps.select(*s.keys, F.explode(F.array("row_before", "start_time", "gap_end", "row_after")).alias(s.ts))
    edges = edges.filter(F.col(s.ts).isNotNull()).distinct().withColumn("__edge", F.lit(True))
    limit = int(max_gap_s * MICROS)
    at = micros(s.ts)
    d = rolling(df, s.with_step(None), 1, 1, lambda w: {
        "__jump": F.coalesce(at - F.lag(at).over(w) > limit, F.lit(False)) | F.coalesce(F.lead(at).over(w) - at > limit, F.lit(False))})
    d = d.join(edges, [*s.keys, s.ts], "left")
    return d.withColumn(out, F.coalesce("__edge", F.lit(False)) | F.col("__jump")).drop("__edge", "__jump")


def long_null_runs(df: DataFrame, s: Series, columns: Sequence[str], limit: int, suffix: str = "_long_gap") -> DataFrame:
    """Per column: whether the row lies in a NULL run of at least ``limit`` rows."""
    return rolling(df, s, limit - 1, limit - 1, *run_stages(s, {f"{c}{suffix}": (F.isnull(c), limit) for c in columns}))


def removed_episodes(removed: Mapping[str, DataFrame], s: Series, step_s: int) -> DataFrame:
    """Episodes of removed rows; stamps within 1.5 steps belong together, the first given cause names the episode."""
    d = None
    for i, (label, stamps) in enumerate(removed.items()):
        part = stamps.select(*s.keys, s.ts, F.struct(F.lit(i).alias("i"), F.lit(label).alias("label")).alias("__c"))
        d = part if d is None else d.unionByName(part)
    d = d.groupBy(*s.keys, s.ts).agg(F.min("__c")["label"].alias("cause"))
    ep = episodes(d, s.with_step(None), F.lit(True), [F.min_by("cause", s.ts).alias("cause")], max_gap=1.5 * step_s)
    return ep.withColumn("duration_hours", hours("start_time", "end_time"))


def removal_summary(eps: DataFrame, kept: DataFrame, s: Series) -> DataFrame:
    """Removal rate, episode count, longest and mean gap, and how concentrated the removals are."""
    e = eps.groupBy(*s.keys).agg(
        F.sum("n_rows").alias("removed"), F.count(F.lit(1)).alias("n_episodes"),
        F.max("duration_hours").alias("max_gap_hours"), F.avg("duration_hours").alias("mean_gap_hours"))
    k = kept.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("kept"))
    d = attach(e, k, s.keys)
    concentration = F.coalesce(ratio(F.col("max_gap_hours"), F.col("mean_gap_hours")), F.lit(1.0))
    return d.withColumns({
        "gap_rate_pct": 100.0 * F.col("removed") / (F.col("removed") + F.col("kept")), "clustering_ratio": concentration})


def all_null_episodes(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Number of runs of rows without any value, and of such rows."""
    none = F.coalesce(*[F.col(c).cast("double") for c in columns]).isNull()
    d = rolling(df.withColumn("__none", none), s, 1, 0, lambda w: {
        "__start": F.col("__none") & ~F.coalesce(F.lag("__none").over(w), F.lit(False))})
    return d.groupBy(*s.keys).agg(F.count_if("__start").alias("n_episodes"), F.count_if("__none").alias("n_rows"))


def completeness(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of filled cells overall and per column."""
    per = {c: 100.0 * F.count(c) / F.count(F.lit(1)) for c in columns}
    return df.groupBy(*keys).agg(
        (sum(per.values(), F.lit(0.0)) / len(columns)).alias("completeness_pct"), *[v.alias(f"{c}_pct") for c, v in per.items()])


def season_fill_share(df: DataFrame, keys: Sequence[str], season: str, masks: Mapping[str, str], a: str, b: str, limit: float = 10.0) -> DataFrame:
    """Interpolated share per column in two seasons, with a warning when they differ by more than ``limit`` points."""
    pct = lambda m, v: 100.0 * F.avg(F.when(F.col(season) == v, F.col(m).cast("int")))
    one = df.groupBy(*keys).agg(*[F.struct(F.lit(c).alias(VARIABLE), pct(m, a).alias("pct_a"), pct(m, b).alias("pct_b")).alias(f"__{c}") for c, m in masks.items()])
    d = one.select(*keys, F.explode(F.array(*[F.col(f"__{c}") for c in masks])).alias("r")).select(*keys, "r.*")
    return d.withColumn("unequal", F.coalesce(F.abs(F.col("pct_a") - F.col("pct_b")) > limit, F.lit(False)))


def weather_fallback(df: DataFrame, s: Series, temp: str, humidity: str, monthly: Mapping[int, float], rh: float = 60.0, limit: int = 6, min_missing_pct: float = 5.0) -> DataFrame:
    """Forward fill up to ``limit`` rows, then month climatology or constant humidity, when enough is missing."""
    share_ = df.groupBy(*s.keys).agg(*[(100.0 * F.avg(F.isnull(c).cast("int"))).alias(f"__m_{c}") for c in (temp, humidity)])
    d = rolling(df, s, limit, 0, lambda w: {f"__f_{c}": F.last(c, True).over(w.rowsBetween(-limit, 0)) for c in (temp, humidity)})
    d = attach(d, share_, s.keys)
    table = F.create_map(*[x for m, v in monthly.items() for x in (F.lit(m), F.lit(float(v)))])
    default = {temp: F.element_at(table, F.month(F.col(s.ts))), humidity: F.lit(rh)}
    need = {c: F.col(f"__m_{c}") > min_missing_pct for c in (temp, humidity)}
    used = [need[c] & F.col(f"__f_{c}").isNull() for c in (temp, humidity)]
    d = d.withColumn("weather_filled", (used[0] | used[1]).cast("int"))
    d = d.withColumns({c: F.when(need[c], F.coalesce(F.col(f"__f_{c}"), default[c])).otherwise(F.col(c)) for c in (temp, humidity)})
    return d.select(*df.columns, "weather_filled")


def quality_checks(df: DataFrame, s: Series, limits: Mapping[str, tuple[float, float]], max_step_h: float = 2.0, min_coverage: float = 90.0, max_missing: float = 10.0, min_rows: Mapping[str, int] | None = None) -> DataFrame:
    """``check, variable, measured, passed`` per key: duplicates, gaps, regular steps, coverage, ranges, constants, 6 sigma.

    ``min_rows`` names checks (constant, near_constant, six_sigma_pct) that columns of that many values and fewer pass.
    """
    few = lambda check: F.col("valid") <= (min_rows or {}).get(check, 0)
    columns = list(limits)
    at = micros(s.ts)
    # holes and repeated stamps are what is looked for, so rows are reached by position
    d = rolling(df, s.with_step(None), 1, 0, lambda w: {"__d": (at - F.lag(at).over(w)) / F.lit(float(MICROS))})
    counts = d.filter("__d IS NOT NULL").groupBy(*s.keys, "__d").agg(F.count(F.lit(1)).alias("c"))
    usual = counts.groupBy(*s.keys).agg(F.max_by("c", F.struct("c", -F.col("__d"))).alias("usual"), F.sum("c").alias("steps"))
    rows = d.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__d") == 0).alias("dup"),
        F.count_if(F.col("__d") > max_step_h * 3600).alias("gaps"), (F.max("__d") / 3600).alias("max_step_h"))
    rows = rows.join(usual, list(s.keys), "left") if s.keys else attach(rows, usual, s.keys)
    irregular = 100.0 * (F.col("n") - F.coalesce("usual", F.lit(0))) / F.col("n")
    check = lambda name, var, val, ok: F.struct(F.lit(name).alias("check"), F.lit(var).alias(VARIABLE), val.cast("double").alias("measured"), ok.alias("passed"))
    table_checks = rows.select(*s.keys, F.explode(F.array(
        check("duplicate_timestamps", "*", F.col("dup"), F.col("dup") == 0),
        check("time_gaps", "*", F.col("gaps"), F.col("gaps") == 0),
        check("irregular_steps_pct", "*", irregular, irregular <= 5.0),
    )).alias("r")).select(*s.keys, "r.*")
    long = melt(df, s.keys, columns)
    by = [*s.keys, VARIABLE]
    st = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(VALUE).alias("valid"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"),
        F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("sd"), F.count_if(F.col(VALUE) == 0).alias("zeros"))
    # distinct counts through a two-step aggregation, so a hot key is counted in parts
    nd = long.filter(F.col(VALUE).isNotNull()).groupBy(*by, VALUE).agg(F.lit(1).alias("o")).groupBy(*by).agg(F.count("o").alias("distinct"))
    st = st.join(nd, by, "left")
    far = long.join(st.select(*by, "mean", "sd"), by).groupBy(*by).agg(F.count_if(F.abs(F.col(VALUE) - F.col("mean")) > 6 * F.col("sd")).alias("far"))
    st = st.join(far, by)
    bounds = F.create_map(*[x for c, (a, b) in limits.items() for x in (F.lit(c), F.array(F.lit(float(a)), F.lit(float(b))))])
    lim = bounds[F.col(VARIABLE)]
    miss, cover = 100.0 * (F.col("n") - F.col("valid")) / F.col("n"), 100.0 * F.col("valid") / F.col("n")
    far_pct = ratio(100.0 * F.col("far"), F.col("valid"))
    col_check = lambda name, val, ok: F.struct(F.lit(name).alias("check"), F.col(VARIABLE), val.cast("double").alias("measured"), F.coalesce(ok, F.lit(True)).alias("passed"))
    col_checks = st.select(*s.keys, F.explode(F.array(
        col_check("coverage_pct", cover, cover >= min_coverage),
        col_check("missing_pct", miss, miss <= max_missing),
        col_check("lowest", F.col("lo"), F.col("lo") >= lim[0]),
        col_check("highest", F.col("hi"), F.col("hi") <= lim[1]),
        col_check("constant", F.col("distinct"), few("constant") | (F.col("distinct") != 1)),
        col_check("near_constant", F.col("distinct"), few("near_constant") | (F.col("distinct") >= 3)),
        col_check("all_zero", F.col("zeros"), ~((F.col("zeros") == F.col("valid")) & (F.col("valid") > 0))),
        col_check("six_sigma_pct", far_pct, few("six_sigma_pct") | (far_pct <= 1.0)),
    )).alias("r")).select(*s.keys, "r.*")
    return table_checks.unionByName(col_checks)

