"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit marks seen in exports, with the usual mis-decoded forms of the degree sign.
UNIT_MARKS = ("Ã‚Â°C", "Â°C", "¬∞C", "°C", "%")


def as_col(c: Column | str) -> Column:
    """Column by name; raw export names may contain dots."""
    if not isinstance(c, str):
        return c
    return F.col(f"`{c}`" if "." in c and "`" not in c else c)


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def clean_number(c: Column | str) -> Column:
    """Text with units and decimal comma to DOUBLE; anything else becomes NULL."""
    text = as_col(c).cast("string")
    for mark in UNIT_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return nan_to_null(F.trim(F.replace(text, F.lit(","), F.lit("."))).try_cast("double"))


def to_number(c: Column | str) -> Column:
    return nan_to_null(F.trim(as_col(c).cast("string")).try_cast("double"))


def parse_time(c: Column | str, *formats: str) -> Column:
    """First format that parses; NULL if none does."""
    c = as_col(c)
    tries = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def in_range(c: Column | str, lo: float, hi: float) -> Column:
    """The value, or NULL when outside the closed range."""
    c = as_col(c)
    return F.when(c.between(lo, hi), c)


def to_local(ts: Column | str, zone: str) -> Column:
    """Instant to local wall clock."""
    return F.from_utc_timestamp(as_col(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def ladder(c: Column, steps: Sequence[tuple[float, str]], other: str) -> Column:
    """``c < bound`` ladder, first match wins; NULL takes ``other``."""
    out = F.when(c < steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        out = out.when(c < bound, label)
    return out.otherwise(other)


def ladder_above(c: Column, steps: Sequence[tuple[float, str]], other: str) -> Column:
    """``c > bound`` ladder, first match wins."""
    out = F.when(c > steps[0][0], steps[0][1])
    for bound, label in steps[1:]:
        out = out.when(c > bound, label)
    return out.otherwise(other)


def ratio(a: Column, b: Column) -> Column:
    """Quotient, NULL for a zero divisor (plain division raises in ANSI mode)."""
    return F.try_divide(a, b)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson coefficient of complete pairs; NULL when a side is constant (``corr`` raises there in ANSI mode)."""
    a, b = as_col(a), as_col(b)
    both = a.isNotNull() & b.isNotNull()
    spread = lambda c: F.stddev_pop(F.when(both, c))
    return ratio(F.covar_pop(a, b), spread(a) * spread(b))


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def share(pred: Column) -> Column:
    """Percentage of all rows where ``pred`` holds; NULL counts as not holding."""
    return 100.0 * F.avg(false_if_null(pred).cast("int"))


def between_dates(ts: Column | str, start: date | datetime | str | None, end: date | datetime | str | None) -> Column:
    """Inclusive range; an open end is allowed."""
    ts, cond = as_col(ts), F.lit(True)
    if start is not None:
        cond = cond & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (ts <= F.lit(end).cast("timestamp_ntz"))
    return cond
