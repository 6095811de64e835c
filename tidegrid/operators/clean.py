"""Projection, parsing and filters: raw text columns to one clean row per timestamp."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import roles
from tidegrid.functions.columns import as_col, clean_number, in_range, parse_time
from tidegrid.plans.blocks import rolling
from tidegrid.plans.quantiles import exact_quantiles
from tidegrid.plans.series import Series, attach, micros

# Coarse plausible range of temperature columns, second time format, summer months.
COARSE_RANGE = (-10.0, 60.0)
SECOND_TIME_FORMAT = "M/d/yyyy h:mm:ss a"
SUMMER_MONTHS = (5, 9)
# Fixed values: (median minutes up to, standard interval), and the interval beyond.
INTERVAL_LADDER = ((2, 1), (7, 5), (12, 10), (20, 15), (40, 30))
LONGEST_INTERVAL = 60
FRACTION_LIMIT = 1.5
# Preset seasons (name, label year, first day, last day).
SEASON_PRESETS = (
    ("summer", 2024, "2024-04-15", "2024-10-14"),
    ("winter", 2025, "2024-10-15", "2025-04-15"),
    ("summer", 2025, "2025-07-09", "2025-10-14"),
    ("winter", 2026, "2025-10-15", "2026-02-18"),
)


def clean_units(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clean_number(c) for c in columns})


def coarse_limits(df: DataFrame, columns: Sequence[str], lo: float = COARSE_RANGE[0], hi: float = COARSE_RANGE[1]) -> DataFrame:
    return df.withColumns({c: in_range(c, lo, hi) for c in columns})


def with_parsed_time(df: DataFrame, text: str, out: str = "ts", fmt: str = SECOND_TIME_FORMAT) -> DataFrame:
    """Parse times, dropping rows that no format parses."""
    return df.withColumn(out, parse_time(text, fmt)).filter(F.col(out).isNotNull())


def localize(df: DataFrame, s: Series, zone: str, out: str = "instant") -> DataFrame:
    """Local wall clock to instant across daylight-saving changes.

    Of several rows with one local time inside the autumn fold, the first is
    summer time and the later ones standard time.  Times in the spring hole move
    to the first valid instant (holes start on a full hour).
    """
    local = F.col(s.ts).cast("timestamp")
    first = F.to_utc_timestamp(local, zone)
    hour_later = first + F.expr("INTERVAL 1 HOUR")
    in_fold = F.from_utc_timestamp(hour_later, zone) == local
    in_hole = F.from_utc_timestamp(first, zone) != local
    # only the rows of the repeated hour need an order: the earliest of each time stays in summer time
    earliest = df.filter(in_fold).groupBy(*s.keys, s.ts).agg(F.min(F.struct(*s.tie)).alias("__e"))
    d = df.join(earliest, [*s.keys, s.ts], "left")
    instant = (
        F.when(in_hole, F.to_utc_timestamp(F.date_trunc("hour", local), zone))
        .when(F.col("__e").isNotNull() & (F.struct(*s.tie) != F.col("__e")), hour_later)
        .otherwise(first)
    )
    return d.withColumn(out, instant).drop("__e")


def rename_signals(df: DataFrame, *maps: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(roles.rename_map(df.columns, *(maps or (roles.WEATHER_NAMES, roles.DISPLAY_NAMES))))


def pick_signal(df: DataFrame, variants: Sequence[str], out: str) -> DataFrame:
    """Resolve a standard signal; when several variants exist the first non-null value wins."""
    present = [v for v in variants if v in df.columns]
    if not present:
        name = roles.resolve(df.columns, variants)
        present = [name] if name else []
    if not present:
        raise ValueError(f"none of {list(variants)} in {df.columns}")
    return df.withColumn(out, F.coalesce(*[F.col(f"`{c}`") for c in present]))


def first_per_timestamp(df: DataFrame, s: Series) -> DataFrame:
    """Drop NULL timestamps and keep the first row (by the tie columns) of each timestamp.

    ``min_by`` over a struct combines on the map side, so many copies of one
    timestamp never meet unreduced in one task.
    """
    rest = [c for c in df.columns if c not in (*s.keys, s.ts)]
    pick = F.min_by(F.struct(*rest), F.struct(*s.tie)) if s.tie else F.min(F.struct(*rest))
    d = df.filter(F.col(s.ts).isNotNull()).groupBy(*s.keys, s.ts).agg(pick.alias("__r"))
    return d.select(*s.keys, s.ts, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def season_of(ts: Column, seasons: Sequence[tuple[str, int, str, str]]) -> Column:
    """Array of the preset seasons ``(season, year, start, end)`` whose dates hold ``ts``."""
    d = F.to_date(ts)
    rows = F.array(*[
        F.struct(F.lit(n).alias("season"), F.lit(y).alias("season_year"),
                 F.to_date(F.lit(a)).alias("start"), F.to_date(F.lit(b)).alias("end"))
        for n, y, a, b in seasons
    ])
    return F.filter(rows, lambda r: (d >= r["start"]) & (d <= r["end"]))


def season_filter(df: DataFrame, ts: str, seasons: Sequence[tuple[str, int, str, str]] = SEASON_PRESETS) -> DataFrame:
    """Rows inside a preset season, labelled ``season, season_year``."""
    d = df.withColumn("__s", F.explode(season_of(F.col(ts), seasons)))
    return d.select(*df.columns, "__s.season", "__s.season_year")


def open_range(df: DataFrame, ts: str, start: str, end: str | None = None) -> DataFrame:
    """From ``start``; to ``end`` inclusive when given."""
    d = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return d if end is None else d.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))


def steps(df: DataFrame, s: Series, out: str = "step_s") -> DataFrame:
    """Seconds since the previous row."""
    return rolling(df, s.with_step(None), 1, 0, lambda w: {out: (micros(s.ts) - F.lag(micros(s.ts)).over(w)) / F.lit(1e6)})


def native_interval(df: DataFrame, s: Series) -> DataFrame:
    """Per key: most frequent and median step in seconds, and the nearest standard interval in minutes."""
    d = steps(df, s).filter(F.col("step_s").isNotNull())
    counts = d.groupBy(*s.keys, "step_s").agg(F.count(F.lit(1)).alias("c"))
    # ties of the mode go to the smaller step
    mode = counts.groupBy(*s.keys).agg(
        F.max_by("step_s", F.struct("c", -F.col("step_s"))).alias("mode_s"), F.sum("c").alias("n_steps")
    )
    med = exact_quantiles(d, s.keys, ["step_s"], [0.5]).select(*s.keys, F.col("q")[0].alias("median_s"))
    out = attach(mode, med, s.keys)
    minutes = F.col("median_s") / 60
    near = F
    for up_to, m in INTERVAL_LADDER:
        near = near.when(minutes <= up_to, m)
    return out.withColumn("interval_min", near.otherwise(LONGEST_INTERVAL))


def detect_season(df: DataFrame, keys: Sequence[str], ts: str, cooling: str, heating: str, explicit: str | None = None) -> DataFrame:
    """``season`` per key: explicit, else the start month, else which setpoint has more values."""
    g = df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.count(cooling).alias("n_cool"), F.count(heating).alias("n_heat"))
    month = F.month("first_ts")
    by_month = F.when(month.between(*SUMMER_MONTHS), "summer").when(month.isNotNull(), "winter")
    by_count = F.when(F.col("n_cool") > F.col("n_heat"), "summer").otherwise("winter")
    return g.withColumn("season", F.coalesce(F.lit(explicit), by_month, by_count))


def percent_scale(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Modulation columns to 0-100: a key whose 99 % quantile of ``abs`` is at most 1.5 is a fraction."""
    d = df.withColumns({f"__abs_{c}": F.abs(F.col(c)) for c in columns})
    q = exact_quantiles(d, keys, [f"__abs_{c}" for c in columns], [0.99])
    wide = q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == f"__abs_{c}", F.col("q")[0])).alias(f"__q_{c}") for c in columns]
    )
    out = attach(df, wide, list(keys))
    out = out.withColumns(
        {c: F.when(F.col(f"__q_{c}") <= FRACTION_LIMIT, F.col(c) * 100).otherwise(F.col(c)) for c in columns}
    )
    return out.drop(*[f"__q_{c}" for c in columns])


def clock_filter(
    df: DataFrame, ts: str, hours: tuple[int, int] | None = None, weekdays_only: bool = False, masks: Sequence[str | Column] = ()
) -> DataFrame:
    """Keep hours ``[a, b]``, weekdays, and rows where no interpolation mask is set."""
    cond = F.lit(True)
    if hours:
        cond = cond & F.hour(ts).between(*hours)
    if weekdays_only:
        cond = cond & (F.weekday(F.col(ts)) < 5)
    for m in masks:
        cond = cond & ~F.coalesce(as_col(m).cast("boolean"), F.lit(False))
    return df.filter(cond)
