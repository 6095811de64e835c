"""What identifies a time series and how its rows are cut into blocks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "__block"
OWNED = "__owned"
SUPER = "__super"
BLOCKS_PER_SUPER = 1440
BLOCK_ROWS = 262_144
MICROS = 1_000_000


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch (the session zone is pinned to UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def seconds(col: Column | str) -> Column:
    """Seconds since the epoch as DOUBLE, keeping fractions."""
    return micros(col) / F.lit(float(MICROS))


def floor_div(a: Column, b: int) -> Column:
    """Exact integer floor division, also for negative values."""
    return ((a - F.pmod(a, F.lit(b).cast("bigint"))) / F.lit(b)).cast("bigint")


@dataclass(frozen=True)
class Series:
    """Key columns, time column and (when on a regular grid) the step in seconds.

    ``tie`` orders rows that share a timestamp.  ``span`` is the length in
    seconds of a time block for irregular series: short, so that a burst on one
    key is still cut into many blocks (totals of blocks are folded in two levels,
    so many nearly empty blocks cost little).
    """

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    step: int | None = None
    tie: tuple[str, ...] = ()
    span: int = 60

    def with_step(self, step: int | None) -> "Series":
        return replace(self, step=step)

    def block_micros(self, rows: int = BLOCK_ROWS) -> int:
        return (self.step * rows if self.step else self.span) * MICROS

    def time_block(self) -> Column:
        return floor_div(micros(self.ts), self.block_micros())

    def order(self, reverse: bool = False) -> list[Column]:
        cols = [F.col(c) for c in (self.ts, *self.tie)]
        return [c.desc() if reverse else c.asc() for c in cols]

    def window(self, reverse: bool = False) -> WindowSpec:
        """Ordered window inside one block; never the whole series."""
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order(reverse))


def attach(df: DataFrame, stats: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Put per-key statistics beside every row.

    With keys this is an equi join (adaptive execution broadcasts a small side
    and splits skewed partitions); without keys ``stats`` is one row and becomes
    a scalar subquery.
    """
    if keys:
        return df.join(stats, list(keys), "left")
    packed = df.withColumn("__s", stats.select(F.struct("*")).scalar())
    return packed.select(*df.columns, *[F.col("__s")[c].alias(c) for c in stats.columns])
