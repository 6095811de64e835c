"""Feature operators over wide signal tables."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.columns import as_col, false_if_null
from tidegrid.plans.blocks import rolling, running
from tidegrid.plans.quantiles import VARIABLE, melt
from tidegrid.plans.series import MICROS, Series, micros

# Day names, occupancy defaults, control defaults.
DAY_NAMES = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
OCCUPIED_FROM, OCCUPIED_TO, SATURDAY_TO = "06:00", "18:00", "14:00"
DEADBAND, TOLERANCE = 0.3, 0.5
LAGS = (1, 2, 3, 6, 12)


def delta_t(df: DataFrame, supply: str, ret: str, out: str = "delta_t_signed") -> DataFrame:
    return df.withColumn(out, F.col(supply) - F.col(ret))


def calendar(df: DataFrame, ts: str) -> DataFrame:
    d = F.weekday(F.col(ts))
    return df.withColumns({"hour_of_day": F.hour(ts), "day_of_week": d, "is_weekend": (d >= 5).cast("int")})


def season_progress(df: DataFrame, ts: str, start: str, end: str, out: str = "season_progress") -> DataFrame:
    """Whole days since the start over the total days, clipped to 0..1."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    days = lambda a: F.floor((micros(a) - F.unix_micros(first)) / (86_400 * MICROS))
    total = F.floor((F.unix_micros(last) - F.unix_micros(first)) / (86_400 * MICROS))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), days(F.col(ts)) / total)))


def cyclic(df: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of hour, weekday, month and day of year."""
    t = F.col(ts)
    parts = {"hour": (F.hour(t), 24), "day_of_week": (F.weekday(t), 7), "month": (F.month(t), 12), "day_of_year": (F.dayofyear(t), 365)}
    angle = lambda c, n: 2 * F.pi() * c / n
    return df.withColumns({
        **{f"{n}_sin": F.sin(angle(c, p)) for n, (c, p) in parts.items()},
        **{f"{n}_cos": F.cos(angle(c, p)) for n, (c, p) in parts.items()},
    })


def parse_days(text: str) -> list[int]:
    """``mon-fri``, ``sat-mon``, ``mon,wed`` or a single day to day numbers (Monday 0); Monday to Friday if unreadable."""
    index = {d: i for i, d in enumerate(DAY_NAMES)}
    text = text.strip().lower()
    if "," in text:
        return [index[d.strip()] for d in text.split(",") if d.strip() in index]
    if "-" in text:
        a, b = (index.get(x.strip()) for x in text.split("-", 1))
        if a is not None and b is not None:
            return [(a + i) % 7 for i in range((b - a) % 7 + 1)]
    return [index[text]] if text in index else [0, 1, 2, 3, 4]


def _minutes(clock: str) -> int:
    h, m = clock.split(":")
    return int(h) * 60 + int(m)


def occupied(df: DataFrame, ts: str, days: str = "mon-fri", start: str = OCCUPIED_FROM, end: str = OCCUPIED_TO, saturday: bool = False, saturday_end: str = SATURDAY_TO, out: str = "is_occupied") -> DataFrame:
    """1 inside ``[start, end)`` of the given days (and Saturday until its own end)."""
    t = F.col(ts)
    minute, day = F.hour(t) * 60 + F.minute(t), F.weekday(t)
    cond = day.isin(parse_days(days)) & (minute >= _minutes(start)) & (minute < _minutes(end))
    if saturday:
        cond = cond | ((day == 5) & (minute >= _minutes(start)) & (minute < _minutes(saturday_end)))
    return df.withColumn(out, cond.cast("int"))


def startup_shutdown(df: DataFrame, s: Series, occupied_col: str = "is_occupied", startup_h: float = 1.0, shutdown_h: float = 1.0) -> DataFrame:
    """Rows within half the window length of an occupancy change on either side."""
    step = max(s.step or 0, 1)
    up, down = int(startup_h * 1800), int(shutdown_h * 1800)
    reach = max(up, down)

    def near(w, change, half):
        at = F.floor(micros(s.ts) / MICROS)
        return F.coalesce(F.max(F.when(F.col("__change") == change, 1)).over(w.orderBy(at).rangeBetween(-half, half)), F.lit(0))

    # one more step before the reach, so that the first row in reach knows its predecessor
    return rolling(
        df, s, reach + step, reach,
        lambda w: {"__change": F.col(occupied_col) - F.lag(occupied_col).over(w)},
        lambda w: {"is_startup": near(w, 1, up), "is_shutdown": near(w, -1, down)},
        in_seconds=True,
    ).drop("__change")


def active_operation(df: DataFrame, supply: str | None, ret: str | None, threshold: float = 0.3, logic: str = "OR", out: str = "is_active_operation") -> DataFrame:
    on = [false_if_null(F.col(c) >= threshold) for c in (supply, ret) if c]
    cond = on[0] if len(on) == 1 else (on[0] | on[1] if logic == "OR" else on[0] & on[1])
    return df.withColumn(out, cond.cast("int"))


def rolling_means(df: DataFrame, s: Series, column: str, windows: dict[str, int]) -> DataFrame:
    """Trailing means over ``n`` rows, from the first row on."""
    n = max(windows.values())
    return rolling(df, s, n - 1, 0, lambda w: {o: F.avg(column).over(w.rowsBetween(-(k - 1), 0)) for o, k in windows.items()})


# Words of a setpoint's name by season, in order of priority.
SETPOINT_WORDS = {
    "summer": (("raffrescamento", "raffreddamento", "cooling"),),
    "winter": (("compensat",), ("riscaldamento", "heating"), ("mandata",), ("",)),
}


def season_setpoint(season: str, columns: Sequence[str]) -> str | None:
    """Setpoint column used in a season, the first that holds a word of the highest priority: cooling alone in summer; in winter the compensated one, heating, supply, or any."""
    names = [c for c in columns if "set point" in c.lower() or "setpoint" in c.lower()]
    for words in SETPOINT_WORDS.get(season.lower(), ()):
        for c in names:
            if any(w in c.lower() for w in words):
                return c
    return None


def setpoint_error(df: DataFrame, measured: str, setpoint: str | None, deadband: float = DEADBAND, out: str = "setpoint_error") -> DataFrame:
    """Measured minus setpoint; errors inside the deadband (and unknown ones) become 0. Without a setpoint for the season all are NULL."""
    if setpoint is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    e = F.col(measured) - F.col(setpoint)
    return df.withColumn(out, F.when(F.abs(e) > deadband, e).otherwise(0.0) if deadband > 0 else e)


def control_features(df: DataFrame, s: Series, error: str = "setpoint_error", tolerance: float = TOLERANCE) -> DataFrame:
    """Cumulative error, error rate, tolerance flag with its running count, absolute and squared error."""
    e = F.col(error)
    d = rolling(df, s, 1, 0, lambda w: {f"{error}_rate": e - F.lag(error).over(w)}, keep_block=True)
    d = d.withColumns({
        "out_of_tolerance": false_if_null(F.abs(e) > tolerance).cast("int"),
        f"abs_{error}": F.abs(e), f"squared_{error}": e * e,
    })
    d = running(d, s, {f"cumulative_{error}": ("sum", e), "time_out_of_tolerance": ("sum", F.col("out_of_tolerance"))})
    return d.withColumn(f"cumulative_{error}", F.when(e.isNotNull(), F.col(f"cumulative_{error}")))


def thermal_power(df: DataFrame, delta: str, fan: str, out: str = "thermal_power_signed") -> DataFrame:
    return df.withColumn(out, F.col(delta) * F.col(fan))


def differences(df: DataFrame, s: Series, columns: dict[str, str]) -> DataFrame:
    """First differences ``{out: column}``; unknown ones are 0."""
    return rolling(df, s.with_step(None), 1, 0, lambda w: {o: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for o, c in columns.items()})


def rates(df: DataFrame, s: Series, columns: Sequence[str], suffix: str = "_rate", abs_suffix: str = "_abs_rate") -> DataFrame:
    """Change per row and its absolute value."""
    return rolling(
        df, s.with_step(None), 1, 0, lambda w: {f"{c}{suffix}": F.col(c) - F.lag(c).over(w) for c in columns}
    ).withColumns({f"{c}{abs_suffix}": F.abs(F.col(f"{c}{suffix}")) for c in columns})


def lags(df: DataFrame, s: Series, columns: Sequence[str], steps: Sequence[int] = LAGS) -> DataFrame:
    return rolling(df, s.with_step(None), max(steps), 0, lambda w: {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in steps})


def feature_summary(df: DataFrame, original: Sequence[str]) -> DataFrame:
    """Mean, std, min, max, count and filled share of the columns that are new."""
    new = [n for n, t in df.dtypes if n not in original and t in ("double", "float", "int", "bigint", "boolean")]
    flat = df.select(*[F.col(c).cast("double").alias(c) for c in new])
    return melt(flat, [], new).groupBy(VARIABLE).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("count"), (100.0 * F.count("value") / F.count(F.lit(1))).alias("filled_pct"))


def ewm_reach(span: float) -> int:
    """Rows after which an exponential weight is below double precision."""
    return ceil(40 / -log(1 - 2 / (span + 1)))


def ewm_columns(x: Column | str, span: float, mean: str, variance: str | None = None):
    """Stage adding the recursive exponential mean (and debiased variance) inside ``w``'s partition.

    ``y = a x + (1 - a) y`` started at the first value is a weighted sum with
    weights growing by ``1 / (1 - a)`` per row, so one running sum per block is
    enough; blocks are short enough for the weights to stay in range, and the
    halo is long enough for the cut-off part to vanish.
    """
    a = 2.0 / (span + 1)
    growth = -log(1 - a)
    x = as_col(x)

    def weigh(w):
        i = F.row_number().over(w)
        c = F.when(i == 1, 1.0).otherwise(a) * F.exp(i * growth)
        # values relative to the first one: no cancellation while a signal is constant
        return {"__i": i, "__c": c, "__x0": F.first(x).over(w), "__sw": F.sum(c).over(w.rowsBetween(w_start, 0))}

    def sums(w):
        upto, c, u = w.rowsBetween(w_start, 0), F.col("__c"), x - F.col("__x0")
        mean_of = lambda v: F.sum(c * v).over(upto) / F.col("__sw")
        extra = {"__m2": mean_of(u * u), "__w2": F.sum(c * c).over(upto) / (F.col("__sw") * F.col("__sw"))}
        return {"__m1": mean_of(u), **(extra if variance else {})}

    def final(w):
        out = {mean: F.col("__x0") + F.col("__m1")}
        if variance:
            spread = F.greatest(F.lit(0.0), F.col("__m2") - F.col("__m1") * F.col("__m1"))
            out[variance] = F.when(F.col("__i") > 1, spread / (1 - F.col("__w2")))
        return out

    w_start = Window.unboundedPreceding
    return weigh, sums, final


def ewm_block_rows(span: float) -> int:
    """Rows per block that keep ``exp(2 * i * growth)`` in range."""
    growth = -log(1 - 2 / (span + 1))
    return max(64, int(300 / growth) - ewm_reach(span))


EWM_SCRATCH = ("__i", "__c", "__x0", "__sw", "__m1", "__m2", "__w2")


def ewm_smooth(df: DataFrame, s: Series, columns: Sequence[str], span: float = 3.0) -> DataFrame:
    """Exponentially smoothed columns (non-null input), restarted per key."""
    reach, rows = ewm_reach(span), ewm_block_rows(span)
    stages = [st for c in columns for st in ewm_columns(c, span, f"__y_{c}")]
    d = rolling(df, s, reach, 0, *stages, rows=rows).drop(*EWM_SCRATCH)
    return d.withColumns({c: F.col(f"__y_{c}") for c in columns}).drop(*[f"__y_{c}" for c in columns])


def thermal_load(df: DataFrame, supply: str, ret: str, season: str, out: str = "thermal_load", signed: str = "delta_t_season") -> DataFrame:
    """Absolute temperature difference, and the difference signed by season (summer return minus supply)."""
    diff = F.col(ret) - F.col(supply)
    return df.withColumns({out: F.abs(diff), signed: F.when(F.col(season) == "summer", diff).otherwise(-diff)})
