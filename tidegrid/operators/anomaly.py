"""Window scoring, thresholds and flags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidegrid.functions.columns import as_col, false_if_null, ratio
from tidegrid.operators.features import EWM_SCRATCH, ewm_block_rows, ewm_columns, ewm_reach
from tidegrid.operators.joins import one_period_back
from tidegrid.plans.blocks import POSITION, positions, rolling, run_stages
from tidegrid.plans.quantiles import VALUE, long_quantiles, melt
from tidegrid.plans.series import BLOCK, MICROS, Series, attach, micros


@dataclass(frozen=True)
class Detection:
    """Defaults of the detection chain."""

    span: float = 10.0
    k: float = 1.2
    smooth: int = 3
    reset_hours: float = 3.0
    grace: int = 20
    persistence: int = 4
    candidate_persistence: int = 3
    percentile: float = 95.0
    occupied_multiplier: float = 0.95
    unoccupied_multiplier: float = 1.05


# Severity multiples, periodicity and physics bounds.
MODERATE_AT, CRITICAL_AT = 1.5, 2.5
PERIOD_S, PERIOD_TOL_S, RATIO_TOL = 86_400, 3_600, 0.5
DIVERGENCE, RAMP, RESPONSE = 2.0, 1.0, 0.25


def array_median(a: Column) -> Column:
    """Median of a small array of numbers, NULL if empty."""
    s = F.array_sort(a)
    n = F.size(a)
    hi, lo = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(s, lo) + F.get(s, hi)) / 2)


@dataclass(frozen=True)
class Reconstruction:
    """A linear autoencoder: window mean and principal directions (both of window size, not of data size)."""

    mean: np.ndarray
    directions: np.ndarray

    def first(self, k: int) -> "Reconstruction":
        """The model of the ``k`` strongest directions."""
        return Reconstruction(self.mean, self.directions[:, :k])

    def apply(self, df: DataFrame, window: str = "window", out: str = "rebuilt") -> DataFrame:
        mean, p = self.mean, self.directions

        @F.pandas_udf(ArrayType(DoubleType()))
        def rebuild(x: pd.Series) -> pd.Series:
            if not len(x):
                return x
            m = np.stack(x.to_numpy()) - mean
            return pd.Series(list(m @ p @ p.T + mean))

        return df.withColumn(out, rebuild(window))


def fit_reconstruction(train: DataFrame, k: int, size: int, window: str = "window") -> Reconstruction | None:
    """Fit on clean training windows; only sums over the data are moved, never windows. None without windows."""
    means = train.agg(*[F.avg(F.get(window, i)).alias(f"m{i}") for i in range(size)]).first()
    if means[0] is None:
        return None
    mean = np.array([float(v) for v in means])
    centred = train.select(F.array(*[F.get(window, i) - F.lit(float(mean[i])) for i in range(size)]).alias("x"))
    vec = centred.select(array_to_vector("x").alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(vec)
    return Reconstruction(mean, model.pc.toArray())


def window_score(x: Column | str, y: Column | str, metric: str = "mae") -> Column:
    """MAE, MSE or RMSE between a window and its reconstruction."""
    d = F.zip_with(as_col(x), as_col(y), lambda a, b: F.abs(a - b) if metric == "mae" else (a - b) * (a - b))
    mean = F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) / F.size(d)
    return F.sqrt(mean) if metric == "rmse" else mean


def feature_score(x: Column | str, y: Column | str, feature: int, n_features: int, length: int) -> Column:
    """MAE of one feature inside a flat time-major window."""
    x, y = as_col(x), as_col(y)
    steps = F.sequence(F.lit(0), F.lit(length - 1))
    cell = lambda a, i: F.get(a, i * n_features + feature)
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.abs(cell(x, i) - cell(y, i))) / length


def last_step(x: Column | str, names: Sequence[str], suffix: str = "") -> list[Column]:
    """Last step of a window as columns (real against rebuilt series)."""
    n = len(names)
    return [F.element_at(as_col(x), i - n).alias(f"{c}{suffix}") for i, c in enumerate(names)]


def percentile_threshold(train: DataFrame, keys: Sequence[str], score: str = "score", pct: float = 95.0) -> DataFrame:
    q = long_quantiles(train.select(*keys, F.col(score).alias(VALUE)), keys, [pct / 100])
    return q.select(*keys, F.col("q")[0].alias("threshold"))


def sigma_threshold(train: DataFrame, keys: Sequence[str], score: str = "score", k: float = 3.0) -> DataFrame:
    return train.groupBy(*keys).agg((F.avg(score) + k * F.stddev_pop(score)).alias("threshold"))


def ewm_statistics(df: DataFrame, s: Series, score: str, span: float, reset_hours: float | None = None, after=None) -> DataFrame:
    """``ewm_mean`` and ``ewm_std`` (NULL on the first row) of non-null scores, restarted after long gaps."""
    at = micros(s.ts)
    gap = at - F.lag(at).over(s.window())
    new = false_if_null(gap > int(reset_hours * 3600 * MICROS)) if reset_hours else F.lit(False)
    ws = Window.partitionBy(*s.keys, BLOCK, "__seg").orderBy(*s.order())
    stages = [lambda w: {"__new": new.cast("int")}, lambda w: {"__seg": F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))}]
    stages += [lambda w, st=st: st(ws) for st in ewm_columns(score, span, "ewm_mean", "__var")]
    stages.append(lambda w: {"ewm_std": F.sqrt("__var")})
    if after is not None:
        stages.append(lambda w: after(ws))
    d = rolling(df, s, ewm_reach(span), 0, *stages, rows=ewm_block_rows(span))
    return d.drop("__new", "__seg", "__var", *EWM_SCRATCH)


def ema_anchor(train: DataFrame, s: Series, score: str = "score", span: float = 10.0, k: float = 1.2) -> DataFrame:
    """Per key: ``anchor``, the exponential mean plus ``k`` deviations at the last training row, and ``train_std``."""
    sd = train.groupBy(*s.keys).agg(F.stddev_pop(score).alias("train_std"))
    d = ewm_statistics(train.select(*s.keys, s.ts, *s.tie, score), s, score, span)
    last = d.groupBy(*s.keys).agg(F.max_by(F.struct("ewm_mean", "ewm_std"), s.ts).alias("e"))
    d = attach(last, sd, s.keys)
    return d.select(*s.keys, (F.col("e.ewm_mean") + k * F.coalesce("e.ewm_std", "train_std")).alias("anchor"), "train_std")


def smooth_scores(df: DataFrame, s: Series, score: str = "score", n: int = 3, out: str = "smoothed") -> DataFrame:
    """Centred rolling median over at most ``n`` rows."""
    half = n // 2
    return rolling(df, s, half, half, lambda w: {out: array_median(F.collect_list(score).over(w.rowsBetween(-half, half)))})


def dynamic_threshold(df: DataFrame, s: Series, anchor: DataFrame, score: str = "smoothed", span: float = 10.0, k: float = 1.2, reset_hours: float | None = 3.0, out: str = "threshold") -> DataFrame:
    """Causal threshold: exponential mean plus ``k`` deviations of the previous row; the anchor starts every segment."""
    d = attach(df, anchor, s.keys)
    prev = lambda ws: {out: F.lag(F.col("ewm_mean") + k * F.coalesce("ewm_std", "train_std")).over(ws)}
    d = ewm_statistics(d, s, score, span, reset_hours, prev)
    return d.withColumn(out, F.coalesce(out, "anchor")).drop("ewm_mean", "ewm_std", "anchor", "train_std")


def occupied_mask(ts: Column | str, start: int = 8, end: int = 18, weekends: bool = False) -> Column:
    """Hours ``[start, end)``, over midnight if ``start > end``, all day if equal; weekdays only unless told."""
    t = as_col(ts)
    h = F.hour(t)
    hours = F.lit(True) if start == end else (h >= start) & (h < end) if start < end else (h >= start) | (h < end)
    return hours if weekends else hours & (F.weekday(t) < 5)


def mode_aware(df: DataFrame, occupied: Column, threshold: str = "threshold", on: float = 0.95, off: float = 1.05) -> DataFrame:
    return df.withColumn(threshold, F.col(threshold) * F.when(occupied, on).otherwise(off))


def flag_scores(df: DataFrame, s: Series, score: str = "smoothed", threshold: str = "threshold", grace: int = 0, out: str = "flag") -> DataFrame:
    """``score > threshold``; the first ``grace`` rows of a series are never flagged."""
    hit = false_if_null(F.col(score) > F.col(threshold))
    if grace <= 0:
        return df.withColumn(out, hit)
    d = df if POSITION in df.columns else positions(df, s, POSITION)
    return d.withColumn(out, hit & (F.col(POSITION) >= grace))


def persistent(df: DataFrame, s: Series, flags: dict[str, tuple[str, int]]) -> DataFrame:
    """``{out: (flag, n)}``: keep flags in runs of at least ``n`` rows."""
    reach = max(n for _, n in flags.values()) - 1
    return rolling(df, s, reach, reach, *run_stages(s, {o: (F.col(f), n) for o, (f, n) in flags.items()}))


def split_rates(df: DataFrame, s: Series, anchor: DataFrame, split: str = "split", p: Detection = Detection(), score: str = "score") -> DataFrame:
    """Anomaly rate of each split under the same smoothing, threshold, grace and persistence (no restarts)."""
    ks = Series((*s.keys, split), s.ts, None, s.tie, s.span)
    d = smooth_scores(positions(df, ks, POSITION), ks, score, p.smooth)
    splits = d.select(*ks.keys).distinct()
    per_split = attach(splits, anchor, s.keys)
    d = dynamic_threshold(d, ks, per_split, "smoothed", p.span, p.k, None)
    d = flag_scores(d, ks, "smoothed", "threshold", p.grace)
    d = persistent(d, ks, {"anomaly": ("flag", p.persistence)})
    return d.groupBy(*ks.keys).agg(F.count(F.lit(1)).alias("n"), (100.0 * F.avg(F.col("anomaly").cast("int"))).alias("anomaly_rate"))


def feature_thresholds(train: DataFrame, keys: Sequence[str], columns: Sequence[str], pct: float = 95.0) -> DataFrame:
    """``keys, <col>_thr``: train percentile of each feature's error."""
    q = long_quantiles(melt(train, keys, columns), [*keys, "variable"], [pct / 100])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("variable") == c, F.col("q")[0])).alias(f"{c}_thr") for c in columns])


def anchored_feature_thresholds(train: DataFrame, anchor: DataFrame, keys: Sequence[str], columns: Sequence[str], score: str = "score") -> DataFrame:
    """Train mean of each feature's error times the ratio of the anchor to the mean score."""
    m = train.groupBy(*keys).agg(F.avg(score).alias("__m"), *[F.avg(c).alias(c) for c in columns])
    by = F.col("anchor") / (F.col("__m") + 1e-9)
    return attach(m, anchor, list(keys)).select(*keys, *[(F.col(c) * by).alias(f"{c}_thr") for c in columns])


def count_anomalous(columns: Sequence[str]) -> Column:
    """Number of features above their threshold (columns ``<col>`` and ``<col>_thr``)."""
    out = F.lit(0)
    for c in columns:
        out = out + false_if_null(F.col(c) > F.col(f"{c}_thr")).cast("int")
    return out


def classify(df: DataFrame, columns: Sequence[str], flag: str = "anomaly", score: str = "score", threshold: str = "threshold", min_features: int = 1, with_severity: bool = True, drop_minor: bool = False) -> DataFrame:
    """Keep flags with enough anomalous features; severity by multiples of the threshold."""
    n = count_anomalous(columns)
    keep = F.col(flag) & (n >= min_features)
    above = lambda m: F.col(score) > m * F.col(threshold)
    level = F.when(above(CRITICAL_AT), "Critical").when(above(MODERATE_AT), "Moderate").otherwise("Minor") if with_severity else F.lit("Anomaly")
    severity = F.when(keep, level).otherwise("Normal")
    d = df.withColumns({"n_anomalous": n, "severity": severity})
    # a hidden minor anomaly keeps its label
    return d.withColumn("filtered", keep & (F.col("severity") != "Minor") if drop_minor else keep)


def transition_guard(df: DataFrame, s: Series, supply: str, return_error: str, stable_below: DataFrame, flag: str = "filtered", ramp: float = 1.5) -> DataFrame:
    """Suppress flags during fast supply changes while the return error stays below ``stable_below.limit``."""
    v = F.col(supply)

    def grad(w):
        left, right = v - F.lag(v).over(w), F.lead(v).over(w) - v
        return {"__g": F.abs(F.coalesce((left + right) / 2, right, left))}

    d = attach(rolling(df, s.with_step(None), 1, 1, grad), stable_below, s.keys)
    calm = false_if_null(F.col("__g") > ramp) & false_if_null(F.col(return_error) < F.col("limit"))
    return d.withColumns({"suppressed": F.col(flag) & calm, flag: F.col(flag) & ~calm}).drop("__g", "limit")


def label_faults(df: DataFrame, s: Series, flag: str, score: str, supply: str, ret: str, coil: str, strict: bool = True, period_s: int = PERIOD_S, tol_s: int = PERIOD_TOL_S, ratio_tol: float = RATIO_TOL) -> DataFrame:
    """Periodic peaks against potential faults: repeats of the day before, and broken physics.

    Signals are known on every row (fill them first).  Strict mode removes every
    periodic flag, physics-breaking ones included, while their label says fault.
    """
    change = lambda c, w: F.coalesce(F.abs(F.col(c) - F.lag(c).over(w)), F.lit(0.0))
    d = rolling(df, s.with_step(None), 1, 0, lambda w: {"__ds": change(supply, w), "__dr": change(ret, w)})
    d = one_period_back(d, s, period_s, tol_s, {"__prev": F.percentile(score, 0.5), "__high": F.max(score), "__hit": F.max(flag)})
    cur, prev = F.col(score) + 1e-9, F.col("__prev") + 1e-9
    times = ratio(F.greatest(cur, prev), F.least(cur, prev))
    high = F.col("__high") >= cur / (1 + ratio_tol)
    seen = F.col("__hit")
    f = F.col(flag)
    periodic = f & false_if_null((times <= 1 + ratio_tol) & (seen | high))
    broken = false_if_null(F.abs(F.col(supply) - F.col(coil)) >= DIVERGENCE) | ((F.col("__ds") >= RAMP) & (F.col("__dr") <= RESPONSE))
    d = d.withColumns({"is_periodic": periodic, "breaks_physics": broken})
    label = F.when(f & F.col("is_periodic") & ~F.col("breaks_physics"), "Operational peak").when(f, "Potential fault").otherwise("Normal")
    d = d.withColumn("label", label)
    return d.withColumn("kept", f & ~F.col("is_periodic") if strict else f).drop("__ds", "__dr", "__prev", "__high", "__hit")


def physics_rules(df: DataFrame, s: Series, supply: str, ret: str, setpoint: str, fan: str, min_delta: float = 0.5, min_fan: float = 30.0, max_error: float = 1.5, hours: float = 4.0) -> DataFrame:
    """Rule 1: little temperature difference while the fan runs; rule 2: long-lasting setpoint error."""
    n = int(hours * 3600 / s.step)
    d = rolling(df, s.with_step(None), n - 1, 0, lambda w: {"__e": F.avg(F.abs(F.col(supply) - F.col(setpoint))).over(w.rowsBetween(-(n - 1), 0))})
    return d.withColumns({
        "rule_low_delta": false_if_null((F.col(supply) - F.col(ret) < min_delta) & (F.col(fan) > min_fan)),
        "rule_setpoint": false_if_null(F.col("__e") > max_error),
    }).drop("__e")


def quality(df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """R2, RMSE, MSE and MAE per ``{name: (real, rebuilt)}``, in the units of the columns."""
    cells = []
    for i, (name, (a, b)) in enumerate(pairs.items()):
        a, b = F.col(a), F.col(b)
        e = a - b
        sst = F.var_pop(F.when(e.isNotNull(), a))
        cells.append(F.struct(
            F.lit(name).alias("feature"), F.count(e).alias("n"), (1 - ratio(F.avg(e * e), sst)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")).alias(f"__{i}"))
    g = df.groupBy(*keys).agg(*cells)
    return g.select(*keys, F.explode(F.array(*[F.col(f"__{i}") for i in range(len(cells))])).alias("q")).select(*keys, "q.*")


def overall_quality(q: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall figures: mean R2, and errors pooled over features."""
    m = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return q.groupBy(*keys).agg(F.avg("r2").alias("r2"), F.sqrt(m("mse")).alias("rmse"), m("mse").alias("mse"), m("mae").alias("mae"))


def context_anchors(df: DataFrame, keys: Sequence[str], flag: str, score: str, pct: float | None = 90.0, ts: str = "ts") -> DataFrame:
    """Flagged rows with a score at or above the flagged rows' percentile (or all of them)."""
    d = df.filter(F.col(flag)).select(*keys, F.col(ts).alias("anchor_ts"), F.col(score).alias("anchor_score"))
    if pct is None:
        return d
    q = long_quantiles(d.select(*keys, F.col("anchor_score").alias(VALUE)), keys, [pct / 100])
    d = attach(d, q.select(*keys, F.col("q")[0].alias("__cut")), list(keys))
    return d.filter(F.col("anchor_score") >= F.col("__cut")).drop("__cut")

