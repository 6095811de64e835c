"""Splits, scaling, clean-data masks and sliding windows for scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.columns import false_if_null
from tidegrid.operators.outlier import beyond, iqr_bounds
from tidegrid.operators.profiles import centred
from tidegrid.plans.blocks import rolling, run_stages
from tidegrid.plans.quantiles import VALUE, VARIABLE, exact_quantiles, long_quantiles, melt
from tidegrid.plans.series import MICROS, Series, attach, micros
from tidegrid.session import durable

# Split shares, smallest useful scaled variance, flat-line bounds.
TRAIN, VALIDATION = 0.70, 0.15
MIN_SCALED_VARIANCE = 0.01
FLAT_STD, LONG_FLAT_ROWS = 0.001, 96
WEEK = 7 * 86_400


def sliding_windows(df: DataFrame, s: Series, columns: Sequence[str], length: int, step_s: int, clean: str | None = None) -> DataFrame:
    """``keys, ts, window[, clean]``: windows of ``length`` rows without NULLs or time jumps, named by their end.

    ``window`` is a flat array, time-major.  A window that spans a jump is
    skipped anyway, so a reach in time of 1.5 steps per row is enough.
    """
    has_null = F.coalesce(*[F.when(F.col(c).isNull(), 1) for c in columns], F.lit(0))
    at, limit = micros(s.ts), int(1.5 * step_s * MICROS)
    d = df.withColumn("__null", has_null)

    def mark(w):
        return {"__jump": F.coalesce((at - F.lag(at).over(w) > limit).cast("int"), F.lit(0))}

    def build(w):
        frame = w.rowsBetween(-(length - 1), 0)
        out = {
            "window": F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(frame)),
            "__ok": (F.count(F.lit(1)).over(frame) == length) & (F.sum("__null").over(frame) == 0)
            & (F.coalesce(F.sum("__jump").over(w.rowsBetween(-(length - 2), 0)), F.lit(0)) == 0 if length > 1 else F.lit(True)),
        }
        if clean:
            out["clean"] = F.min(F.coalesce(F.col(clean).cast("int"), F.lit(0))).over(frame) == 1
        return out

    d = rolling(d, s, int(1.5 * step_s * length), 0, mark, build, in_seconds=True)
    return d.filter("__ok").select(*s.keys, s.ts, "window", *(["clean"] if clean else []))


def plain_windows(df: DataFrame, s: Series, columns: Sequence[str], length: int) -> DataFrame:
    """All windows of ``length`` rows without checks."""
    def build(w):
        frame = w.rowsBetween(-(length - 1), 0)
        return {
            "window": F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(frame)),
            "__n": F.count(F.lit(1)).over(frame),
        }

    d = rolling(df, s, length - 1, 0, build)
    return d.filter(F.col("__n") == length).select(*s.keys, s.ts, "window")


def split_by_week(df: DataFrame, s: Series, train: float = TRAIN, validation: float = VALIDATION, out: str = "split") -> DataFrame:
    """Chronological split by 7-day bins since the first row: train, then validation, then test."""
    first = df.groupBy(*s.keys).agg(F.min(micros(s.ts)).alias("__first"))
    d = attach(df, first, s.keys)
    d = d.withColumn("__week", F.floor((micros(s.ts) - F.col("__first")) / (WEEK * MICROS))).drop("__first")
    # one row per week and key from here on
    weeks = d.groupBy(*s.keys, "__week").agg(F.lit(1).alias("__x"))
    w = Window.partitionBy(*s.keys)
    weeks = weeks.withColumns({"__i": F.row_number().over(w.orderBy("__week")), "__n": F.count(F.lit(1)).over(w)})
    n_train = F.greatest(F.lit(1), F.floor(F.col("__n") * train))
    n_val = F.greatest(F.lit(1), F.floor(F.col("__n") * validation))
    label = F.when(F.col("__i") <= n_train, "train").when(F.col("__i") <= n_train + n_val, "val").otherwise("test")
    return d.join(weeks.select(*s.keys, "__week", label.alias(out)), [*s.keys, "__week"]).drop("__week")


def cap_and_exclude(df: DataFrame, ts: str, last: str | None = None, exclude: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Drop rows after ``last`` and inside the excluded ranges (both ends included)."""
    t = F.col(ts)
    cond = t <= F.lit(last).cast("timestamp_ntz") if last else F.lit(True)
    for a, b in exclude:
        cond = cond & ~t.between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
    return df.filter(cond)


def _centred_std(c: str, w, n: int, full: bool = True) -> Column:
    before, after = centred(n)
    frame = w.rowsBetween(-before, after)
    sd = F.stddev_samp(c).over(frame)
    return F.when(F.count(c).over(frame) == n, sd) if full else sd


def _gated(df: DataFrame, s: Series, flags: Sequence[str], share: float) -> DataFrame:
    """Switch a flag off for keys where it hits at most a share of their rows; 0 leaves every flag as it is."""
    if not share:
        return df
    total = df.groupBy(*s.keys).agg(*[F.avg(F.col(f).cast("int")).alias(f"__n_{f}") for f in flags])
    d = attach(df, total, s.keys)
    return d.withColumns({f: F.col(f) & (F.col(f"__n_{f}") > share) for f in flags}).drop(*[f"__n_{f}" for f in flags])


def _any(df: DataFrame, flags: Sequence[str], out: str) -> DataFrame:
    hit = F.lit(False)
    for f in flags:
        hit = hit | F.col(f)
    return df.withColumn(out, hit).drop(*flags)


def flat_rows(df: DataFrame, s: Series, columns: Sequence[str], window: int = 12, std: float = 0.05, min_share: float = 0.0, out: str = "is_flat") -> DataFrame:
    """Rows where a sensor's centred deviation is below ``std``, of columns where more than ``min_share`` of the rows are so."""
    before, after = centred(window)
    flags = [f"__flat_{c}" for c in columns]
    d = rolling(df, s, before, after, lambda w: {f"__flat_{c}": false_if_null(_centred_std(c, w, window) < std) for c in columns})
    return _any(_gated(d, s, flags, min_share), flags, out)


def fit_scaler(train: DataFrame, keys: Sequence[str], columns: Sequence[str], kind: str = "robust") -> DataFrame:
    """``keys, variable, center, scale``; a zero scale becomes NULL so the column can be dropped."""
    if kind == "robust":
        q = exact_quantiles(train, keys, columns, [0.25, 0.5, 0.75])
        d = q.select(*keys, VARIABLE, F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
    else:
        g = melt(train, keys, columns).groupBy(*keys, VARIABLE)
        if kind == "standard":
            d = g.agg(F.avg(VALUE).alias("center"), F.stddev_pop(VALUE).alias("scale"))
        else:
            d = g.agg(F.min(VALUE).alias("center"), (F.max(VALUE) - F.min(VALUE)).alias("scale"))
    return d.withColumn("scale", F.when(F.col("scale") != 0, F.col("scale")))


def _wide_params(params: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return params.groupBy(*keys).agg(*[F.max(F.when(F.col(VARIABLE) == c, F.struct("center", "scale"))).alias(f"__p_{c}") for c in columns])


def scale(df: DataFrame, params: DataFrame, keys: Sequence[str], columns: Sequence[str], inverse: bool = False) -> DataFrame:
    """Apply (or undo) the fitted scaling."""
    d = attach(df, _wide_params(params, keys, columns), list(keys))
    p = lambda c, f: F.col(f"__p_{c}")[f]
    to = (lambda c: F.col(c) * p(c, "scale") + p(c, "center")) if inverse else (lambda c: (F.col(c) - p(c, "center")) / p(c, "scale"))
    return d.withColumns({c: to(c) for c in columns}).drop(*[f"__p_{c}" for c in columns])


def scaled_variance(train: DataFrame, params: DataFrame, keys: Sequence[str], columns: Sequence[str], minimum: float = MIN_SCALED_VARIANCE) -> DataFrame:
    """Variance of each column after scaling and whether it is worth keeping."""
    v = melt(train, keys, columns).groupBy(*keys, VARIABLE).agg(F.var_samp(VALUE).alias("__v"))
    d = v.join(params, [*keys, VARIABLE])
    d = d.withColumn("scaled_variance", F.col("__v") / (F.col("scale") * F.col("scale")))
    return d.select(*keys, VARIABLE, "scaled_variance", false_if_null(F.col("scaled_variance") >= minimum).alias("keep"))


def inactive(df: DataFrame, fans: Sequence[str], percent: float = 5.0, out: str = "is_inactive") -> DataFrame:
    """No fan (in percent) reaches the threshold."""
    on = F.lit(False)
    for f in fans:
        on = on | false_if_null(F.col(f) >= percent)
    return df.withColumn(out, ~on)


def long_flat_runs(df: DataFrame, s: Series, columns: Sequence[str], rows: int = LONG_FLAT_ROWS, std: float = FLAT_STD, out: str = "is_long_flat") -> DataFrame:
    """Runs of at least ``rows`` rows whose centred deviation over ``rows`` rows is practically zero."""
    before, after = centred(rows)
    flags = [f"__lf_{c}" for c in columns]
    d = rolling(
        df, s, before + rows - 1, after + rows - 1,
        lambda w: {f"__f_{c}": false_if_null(_centred_std(c, w, rows) < std) for c in columns},
        *run_stages(s, {f"__lf_{c}": (F.col(f"__f_{c}"), rows) for c in columns}),
    ).drop(*[f"__f_{c}" for c in columns])
    return _any(d, flags, out)


def interpolated_rows(df: DataFrame, s: Series, masks: Sequence[str], columns: Sequence[str], window: int = 6, std: float = FLAT_STD, out: str = "is_filled", min_share: float = 0.0) -> DataFrame:
    """Any interpolation mask set; without masks, short flat stretches."""
    if masks:
        hit = F.lit(False)
        for m in masks:
            hit = hit | false_if_null(F.col(m).cast("int") > 0)
        return df.withColumn(out, hit)
    return flat_rows(df, s, columns, window, std, min_share, out)


def out_of_range(df: DataFrame, keys: Sequence[str], columns: Sequence[str], limits: Mapping[str, tuple[float, float]] | None = None, out: str = "is_out_of_range") -> DataFrame:
    """Outside the physical limits, or beyond three IQR when no limits are given."""
    if limits:
        hit = F.lit(False)
        for c in columns:
            if c in limits:
                hit = hit | beyond(c, float(limits[c][0]), float(limits[c][1]))
        return df.withColumn(out, hit)
    b = iqr_bounds(df, keys, columns, 3.0)
    wide = b.groupBy(*keys).agg(*[F.max(F.when(F.col(VARIABLE) == c, F.struct("lower", "upper"))).alias(f"__b_{c}") for c in columns])
    d = attach(df, wide, list(keys))
    hit = F.lit(False)
    for c in columns:
        hit = hit | beyond(c, F.col(f"__b_{c}.lower"), F.col(f"__b_{c}.upper"))
    return d.withColumn(out, hit).drop(*[f"__b_{c}" for c in columns])


def high_variance(df: DataFrame, s: Series, columns: Sequence[str], window: int = 12, factor: float = 5.0, min_share: float = 0.0, out: str = "is_noisy") -> DataFrame:
    """Centred deviation far above the column's overall deviation, of columns where more than ``min_share`` of the rows are so."""
    before, after = centred(window)
    total = df.groupBy(*s.keys).agg(*[F.stddev_samp(c).alias(f"__g_{c}") for c in columns])
    d = rolling(df, s, before, after, lambda w: {f"__s_{c}": _centred_std(c, w, window) for c in columns})
    d = attach(d, total, s.keys)
    flags = [f"__h_{c}" for c in columns]
    d = d.withColumns({f"__h_{c}": false_if_null(F.col(f"__s_{c}") > factor * F.col(f"__g_{c}")) for c in columns})
    d = d.drop(*[f"__{p}_{c}" for c in columns for p in "sg"])
    return _any(_gated(d, s, flags, min_share), flags, out)


def transients(df: DataFrame, s: Series, setpoints: Sequence[str], fans: Sequence[str], setpoint_step: float = 0.5, fan_percent: float = 10.0, hold: int = 2, out: str = "is_transient") -> DataFrame:
    """Setpoint steps and fan on/off changes, and the next ``hold`` rows."""
    def trigger(w):
        t = F.lit(False)
        for c in setpoints:
            t = t | false_if_null(F.abs(F.col(c) - F.lag(c).over(w)) >= setpoint_step)
        for c in fans:
            # an unknown value is neither on nor off
            on, off = false_if_null(F.col(c) > fan_percent), false_if_null(F.col(c) <= fan_percent)
            t = t | (on & (F.lag(on).over(w) == F.lit(False))) | (off & (F.lag(off).over(w) == F.lit(False)))
        return {"__t": F.coalesce(t, F.lit(False)).cast("int")}

    d = rolling(df, s, hold + 1, 0, trigger, lambda w: {out: F.max("__t").over(w.rowsBetween(-hold, 0)) == 1})
    return d.drop("__t")


def clean_rows(df: DataFrame, bad: Sequence[str], out: str = "is_clean") -> DataFrame:
    hit = F.lit(False)
    for f in bad:
        hit = hit | F.coalesce(F.col(f), F.lit(False))
    return df.withColumn(out, ~hit)


def clean_windows(windows: DataFrame) -> DataFrame:
    """Windows in which every step is clean."""
    return windows.filter("clean")


def window_feature_means(n_features: int, length: int) -> list[Column]:
    """Mean of each feature over a flat time-major window."""
    pick = lambda f: F.aggregate(
        F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0.0), lambda acc, i: acc + F.get("window", i * n_features + f)
    )
    return [pick(f) / length for f in range(n_features)]


def mad_filter(windows: DataFrame, s: Series, n_features: int, length: int, top_pct: float = 5.0, out: str = "is_extreme") -> DataFrame:
    """Flag windows whose worst feature mean is among the ``top_pct`` % farthest from the median in MADs."""
    feats = [f"__m{f}" for f in range(n_features)]
    # three quantile rounds, each needing the one before: stored so that none repeats the work above it
    d = durable(windows.withColumns(dict(zip(feats, window_feature_means(n_features, length)))))
    med = _medians(d, s.keys, feats, "__c")
    d = attach(d, med, s.keys).withColumns({f"{f}d": F.abs(F.col(f) - F.col(f"{f}__c")) for f in feats})
    mad = _medians(d, s.keys, [f"{f}d" for f in feats], "__a")
    d = attach(d, mad, s.keys)
    z = [F.col(f"{f}d") / (F.col(f"{f}d__a") + 1e-8) for f in feats]
    d = durable(d.withColumn("max_z", F.greatest(*z) if len(z) > 1 else z[0]).select(*windows.columns, "max_z"))
    cut = long_quantiles(d.select(*s.keys, F.col("max_z").alias(VALUE)), s.keys, [1 - top_pct / 100])
    d = attach(d, cut.select(*s.keys, F.col("q")[0].alias("__cut")), s.keys)
    d = d.withColumn(out, F.col("max_z") > F.col("__cut"))
    return d.select(*windows.columns, "max_z", out)


def _medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str) -> DataFrame:
    q = exact_quantiles(df, keys, columns, [0.5])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col(VARIABLE) == c, F.col("q")[0])).alias(f"{c}{suffix}") for c in columns])
