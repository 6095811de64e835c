"""Outlier flags, limits and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.columns import as_col, false_if_null, ratio
from tidegrid.operators.missing import long_series
from tidegrid.plans.blocks import rolling, run_stages
from tidegrid.plans.quantiles import VALUE, VARIABLE, exact_quantiles, long_quantiles, melt
from tidegrid.plans.series import Series, attach
from tidegrid.session import durable

# Hard-limit tables per signal, base and by season.
BASE_LIMITS = {
    "Temperatura Ripresa": (10, 40),
    "Temperatura Mandata": (10, 40),
    "Temperatura Saturazione": (10, 40),
    "Set Points Temperatura Mandata": (15, 21),
    "Set Points Temperatura Compensata": (15, 21),
    "Temperatura Esterna": (-10, 45),
    "Modulazione Ventilatore Ripresa": (0, 100),
    "Modulazione Ventilatore Mandata": (0, 100),
    "Umidita Esterna": (0, 100),
}
SEASON_LIMITS = {
    "summer": {"Set Points Temperatura Mandata": (15, 22), "Set Points Temperatura Compensata": (15, 22)},
    "winter": {"Set Points Temperatura Mandata": (15, 30), "Set Points Temperatura Compensata": (15, 30)},
}
DROP_ABOVE_PCT = 10.0
DISCRETE_RATIO, DISCRETE_VALUES, CONTINUOUS_RATIO = 0.05, 10, 0.20
FLAGS = ("physical", "spike", "stuck", "valid_state", "iqr", "iqr_regime")


@dataclass(frozen=True)
class Rules:
    """Which detectors apply to a column, with their parameters."""

    limits: tuple[float, float] | None = None
    spike_k: float | None = None
    spike_window: int | None = None
    stuck_rows: int | None = None
    stuck_tolerance: float = 0.01
    iqr_k: float | None = None
    regime_column: str | None = None
    regime_bins: int = 5
    states: tuple[float, ...] | None = None
    state_tolerance: float = 0.5


def beyond(c: Column | str, lo: Column | float, hi: Column | float) -> Column:
    c = as_col(c)
    return false_if_null((c < lo) | (c > hi))


def not_a_state(c: Column | str, states: Sequence[float], tolerance: float = 0.5) -> Column:
    """True when the value is near none of the states; NULL counts as an outlier."""
    c = as_col(c)
    near = F.exists(F.array(*[F.lit(float(x)) for x in states]), lambda x: F.abs(c - x) <= tolerance)
    return ~false_if_null(near)


def resolve_limits(variable: Column, season: Column, base: Mapping = BASE_LIMITS, seasonal: Mapping = SEASON_LIMITS) -> Column:
    """``array(lo, hi)`` of a signal: the season's entry if there is one, else the base entry."""
    pair = lambda p: F.array(F.lit(float(p[0])), F.lit(float(p[1])))
    table = lambda t: F.create_map(*[x for k, p in t.items() for x in (F.lit(k), pair(p))])
    by_season = {f"{s}|{v}": p for s, t in seasonal.items() for v, p in t.items()}
    return F.coalesce(F.try_element_at(table(by_season), F.concat_ws("|", F.lower(season), variable)), F.try_element_at(table(base), variable))


def iqr_bounds(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: float) -> DataFrame:
    """``keys, variable, n, q1, q3, lower, upper``."""
    q = exact_quantiles(df, keys, columns, [0.25, 0.75])
    return _fences(q, k).select(*keys, VARIABLE, "n", "q1", "q3", "lower", "upper")


def _fences(q: DataFrame, k: float | Column) -> DataFrame:
    q = q.withColumns({"q1": F.col("q")[0], "q3": F.col("q")[1]})
    spread = k * (F.col("q3") - F.col("q1"))
    return q.withColumns({"lower": F.col("q1") - spread, "upper": F.col("q3") + spread})


def iqr_flags(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: float, suffix: str = "_iqr") -> DataFrame:
    """Wide boolean flags beyond the fences of each key."""
    b = iqr_bounds(df, keys, columns, k)
    wide = b.groupBy(*keys).agg(*[F.max(F.when(F.col(VARIABLE) == c, F.struct("lower", "upper"))).alias(f"__b_{c}") for c in columns])
    d = attach(df, wide, list(keys))
    return d.withColumns({f"{c}{suffix}": beyond(c, F.col(f"__b_{c}.lower"), F.col(f"__b_{c}.upper")) for c in columns}).drop(*[f"__b_{c}" for c in columns])


def regime_id(df: DataFrame, keys: Sequence[str], regime: str, bins: int, out: str = "regime") -> DataFrame:
    """Equal-frequency bin of the regime column by exact edges; equal edges merge, bins are closed on the right."""
    q = exact_quantiles(df, keys, [regime], [i / bins for i in range(bins + 1)])
    d = attach(df, q.select(*keys, F.array_distinct("q").alias("__e")), list(keys))
    inner = F.slice("__e", F.lit(2), F.greatest(F.size("__e") - 2, F.lit(0)))
    below = F.size(F.filter(inner, lambda e: e < F.col(regime)))
    return d.withColumn(out, F.when(F.col(regime).isNotNull(), below)).drop("__e")


def regime_bounds(df: DataFrame, keys: Sequence[str], column: str, k: float) -> DataFrame:
    """Fences per regime with the number of its values, whatever that is."""
    d = df.select(*keys, "regime", F.col(column).cast("double").alias(VALUE)).filter("regime IS NOT NULL")
    q = long_quantiles(d, [*keys, "regime"], [0.25, 0.75])
    return _fences(q, k).select(*keys, "regime", "lower", "upper", "n")


def regime_iqr_flags(df: DataFrame, keys: Sequence[str], column: str, regime: str, k: float, bins: int = 5, out: str = "iqr_regime") -> DataFrame:
    # the fences need two more passes over the labelled rows
    d = durable(regime_id(df, keys, regime, bins))
    b = regime_bounds(d, keys, column, k).drop("n")
    d = d.join(b, [*keys, "regime"], "left")
    return d.withColumn(out, beyond(column, F.col("lower"), F.col("upper"))).drop("lower", "upper", "regime")


def _change(w: WindowSpec) -> dict[str, Column]:
    return {"__d": F.abs(F.col(VALUE) - F.lag(VALUE).over(w))}


def changes(df: DataFrame, s: Series, columns: Sequence[str]) -> tuple[DataFrame, Series]:
    """Long form of the known values with the absolute change ``__d`` since the last known value."""
    long, ls = long_series(df, s, columns)
    ls = ls.with_step(None)
    return rolling(long.filter(F.col(VALUE).isNotNull()), ls, 1, 0, _change), ls


def spikes(df: DataFrame, s: Series, columns: Sequence[str], k: float = 3.0, window: int | None = None) -> DataFrame:
    """``keys, ts, variable, value, threshold, spike``: change beyond ``k`` standard deviations of the changes."""
    if window is None:
        d, ls = changes(df, s, columns)
        sd = d.groupBy(*ls.keys).agg((k * F.stddev_samp("__d")).alias("threshold"))
        d = d.join(sd, list(ls.keys))
    else:
        long, ls = long_series(df, s, columns)
        ls = ls.with_step(None)
        d = rolling(
            long.filter(F.col(VALUE).isNotNull()), ls, window, 0, _change,
            lambda w: {"threshold": k * F.stddev_samp("__d").over(w.rowsBetween(-(window - 1), 0))},
        )
    return d.withColumn("spike", false_if_null(F.col("__d") > F.col("threshold"))).drop("__d")


def spike_thresholds(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median threshold and number of spikes per column."""
    q = long_quantiles(flagged.select(*keys, VARIABLE, F.col("threshold").alias(VALUE)), [*keys, VARIABLE], [0.5])
    n = flagged.groupBy(*keys, VARIABLE).agg(F.count_if("spike").alias("n_spikes"))
    return n.join(q.select(*keys, VARIABLE, F.col("q")[0].alias("threshold")), [*keys, VARIABLE], "left")


def stuck(df: DataFrame, s: Series, columns: Sequence[str], rows: int = 10, tolerance: float = 0.01) -> DataFrame:
    """``keys, ts, variable, value, stuck``: at least ``rows`` consecutive changes within the tolerance."""
    long, ls = long_series(df, s, columns)
    flat = lambda w: {"__flat": false_if_null(F.abs(F.col(VALUE) - F.lag(VALUE).over(w)) <= tolerance)}
    return rolling(
        long.filter(F.col(VALUE).isNotNull()), ls.with_step(None), rows, rows - 1, flat,
        *run_stages(ls, {"stuck": (F.col("__flat"), rows)}),
    ).drop("__flat")


def value_kinds(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Discrete, continuous or mixed by the share of distinct values (counted in two steps)."""
    d = melt(df, keys, columns).filter(F.col(VALUE).isNotNull()).groupBy(*keys, VARIABLE, VALUE).agg(F.count(F.lit(1)).alias("c"))
    d = d.groupBy(*keys, VARIABLE).agg(F.count(F.lit(1)).alias("unique_count"), F.sum("c").alias("n"))
    part = F.col("unique_count") / F.col("n")
    kind = F.when((part < DISCRETE_RATIO) | (F.col("unique_count") <= DISCRETE_VALUES), "discrete").when(part > CONTINUOUS_RATIO, "continuous")
    return d.withColumns({"unique_ratio": part, "kind": kind.otherwise("mixed")})


def flag_table(df: DataFrame, s: Series, rules: Mapping[str, Rules]) -> DataFrame:
    """Long flags per row and column: the six detectors, ``hard``, ``soft`` and ``outlier``.

    Spike, stuck and IQR look at known values only; a missing value can only
    break the valid-state rule.
    """
    cols = list(rules)
    per = lambda fn, default=None: _by_variable({c: fn(r) for c, r in rules.items()}, default)
    long, ls = long_series(df, s, cols)
    known = long.filter(F.col(VALUE).isNotNull())
    stuck_rows = sorted({r.stuck_rows for r in rules.values() if r.stuck_rows})
    windows = sorted({r.spike_window for r in rules.values() if r.spike_k and r.spike_window})
    reach = max([1, *stuck_rows, *[w for w in windows]])
    tol = per(lambda r: r.stuck_tolerance)
    k = per(lambda r: r.spike_k)

    def local(w):
        return {f"__std{n}": F.stddev_samp("__d").over(w.rowsBetween(-(n - 1), 0)) for n in windows}

    d = rolling(
        known, ls.with_step(None), reach, max([0, *[n - 1 for n in stuck_rows]]), _change,
        lambda w: {"__flat": false_if_null(F.col("__d") <= tol)}, local, *run_stages(ls, {f"__stuck{n}": (F.col("__flat"), n) for n in stuck_rows}),
    )
    # read by the statistics, the fences and the flags
    d = durable(d)
    stats = d.groupBy(*ls.keys).agg(F.stddev_samp("__d").alias("__std0"))
    fences = _fences(long_quantiles(d, list(ls.keys), [0.25, 0.75]), per(lambda r: r.iqr_k)).select(*ls.keys, "lower", "upper")
    d = d.join(stats, list(ls.keys)).join(fences, list(ls.keys))
    std = _by_variable({c: F.col(f"__std{r.spike_window or 0}") for c, r in rules.items() if r.spike_k})
    stuck_flag = _by_variable({c: F.col(f"__stuck{r.stuck_rows}") for c, r in rules.items() if r.stuck_rows})
    v = F.col(VALUE)
    d = d.withColumns({
        "spike": false_if_null(F.col("__d") > k * std),
        "stuck": false_if_null(stuck_flag),
        "iqr": beyond(v, F.col("lower"), F.col("upper")),
    }).select(*ls.keys, s.ts, VALUE, "spike", "stuck", "iqr")
    no = F.lit(False)
    empty = long.filter(v.isNull()).select(*ls.keys, s.ts, VALUE, no.alias("spike"), no.alias("stuck"), no.alias("iqr"))
    d = d.unionByName(empty)
    lo, hi = per(lambda r: r.limits[0] if r.limits else None), per(lambda r: r.limits[1] if r.limits else None)
    states = _by_variable({c: not_a_state(VALUE, r.states, r.state_tolerance) for c, r in rules.items() if r.states})
    d = d.withColumns({"physical": beyond(v, lo, hi), "valid_state": false_if_null(states)})
    regimes = None
    for c, r in rules.items():
        if r.regime_column and r.iqr_k:
            f = regime_iqr_flags(df.select(*s.keys, s.ts, *dict.fromkeys([c, r.regime_column])), s.keys, c, r.regime_column, r.iqr_k, r.regime_bins)
            f = f.filter("iqr_regime").select(*s.keys, F.lit(c).alias(VARIABLE), s.ts, "iqr_regime")
            regimes = f if regimes is None else regimes.unionByName(f)
    d = d.join(regimes, [*ls.keys, s.ts], "left") if regimes is not None else d.withColumn("iqr_regime", F.lit(False))
    d = d.withColumn("iqr_regime", false_if_null(F.col("iqr_regime")))
    hard = F.col("physical") | F.col("spike") | F.col("stuck") | F.col("valid_state")
    soft = F.col("iqr") | F.col("iqr_regime")
    return d.withColumns({"hard": hard, "soft": soft, "outlier": hard | soft})


def _by_variable(values: Mapping[str, object], default=None) -> Column:
    out = F
    for c, x in values.items():
        out = out.when(F.col(VARIABLE) == c, x if isinstance(x, Column) else F.lit(x))
    return out.otherwise(F.lit(default)) if values else F.lit(default)


def outlier_summary(flags: DataFrame, keys: Sequence[str], drop_above: float = DROP_ABOVE_PCT) -> DataFrame:
    """Counts and shares of known values per column, DROP when too many hard outliers."""
    n = F.count(VALUE)
    pct = lambda c: ratio(100.0 * F.count_if(c), n)
    d = flags.groupBy(*keys, VARIABLE).agg(
        n.alias("total_points"), F.count_if("outlier").alias("outliers"), pct("outlier").alias("outlier_pct"),
        F.count_if("hard").alias("hard_outliers"), pct("hard").alias("hard_pct"), F.count_if("soft").alias("soft_flags"),
        pct("soft").alias("soft_pct"), *[F.count_if(f).alias(f"n_{f}") for f in FLAGS],
    )
    return d.withColumn("recommendation", F.when(F.col("hard_pct") > drop_above, "DROP").otherwise("KEEP"))


def wide_flags(flags: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Nine flag columns per signal beside its value."""
    names = ("outlier", "hard", "soft", *FLAGS)
    pick = lambda c, f: F.max(F.when(F.col(VARIABLE) == c, F.col(f)))
    return flags.groupBy(*s.keys, s.ts).agg(*[
        x for c in columns for x in (pick(c, VALUE).alias(c), *[pick(c, f).alias(f"{c}_{f}") for f in names])
    ])


def null_hard_outliers(df: DataFrame, flags: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Set hard outliers to NULL before interpolation."""
    w = flags.filter("hard").groupBy(*s.keys, s.ts).agg(*[F.max(F.col(VARIABLE) == c).alias(f"__h_{c}") for c in columns])
    d = df.join(w, [*s.keys, s.ts], "left")
    return d.withColumns({c: F.when(~false_if_null(F.col(f"__h_{c}")), F.col(c)) for c in columns}).drop(*[f"__h_{c}" for c in columns])


def statistical_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: float = 1.5, z: float = 3.0) -> DataFrame:
    """Values beyond the IQR fences and beyond ``z`` standard deviations, with shares."""
    by = [*keys, VARIABLE]
    long = melt(df, keys, columns).filter(F.col(VALUE).isNotNull())
    b = _fences(long_quantiles(long, by, [0.25, 0.75]), k).select(*by, "lower", "upper")
    m = long.groupBy(*by).agg(F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("sd"))
    d = long.join(b.join(m, by), by)
    v = F.col(VALUE)
    d = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(beyond(v, F.col("lower"), F.col("upper"))).alias("iqr_outliers"),
        F.count_if(F.abs(v - F.col("mean")) > z * F.when(F.col("sd") > 0, F.col("sd"))).alias("z_outliers"),
    )
    return d.withColumns({"iqr_pct": 100.0 * F.col("iqr_outliers") / F.col("n"), "z_pct": 100.0 * F.col("z_outliers") / F.col("n")})


def tukey_report(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Fences, number outside, and the observed range inside as suggested cleaning bounds."""
    by = [*keys, VARIABLE]
    long = melt(df, keys, columns).filter(F.col(VALUE).isNotNull())
    b = _fences(long_quantiles(long, by, [0.25, 0.75]), k).select(*by, "q1", "q3", "lower", "upper")
    out = beyond(VALUE, F.col("lower"), F.col("upper"))
    d = long.join(b, by).groupBy(*by, "q1", "q3", "lower", "upper").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(out).alias("n_outside"),
        F.min(F.when(~out, F.col(VALUE))).alias("keep_from"), F.max(F.when(~out, F.col(VALUE))).alias("keep_to"))
    return d.withColumn("outside_pct", 100.0 * F.col("n_outside") / F.col("n"))
