"""Ordered computations that never put a whole series into one task.

A key may hold a third of all rows, so ``Window.partitionBy(key)`` over raw rows
is never used.  Two plans replace it:

* bounded frames (lags, rolling windows): ``rolling`` cuts the series into blocks
  and copies the few rows a frame can reach into the neighbouring block;
* unbounded frames (running max / sum, forward fill, run starts): ``running``
  computes inside blocks and adds the folded totals of the earlier blocks, a
  table with one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.plans.series import (
    BLOCK,
    BLOCK_ROWS,
    BLOCKS_PER_SUPER,
    MICROS,
    OWNED,
    SUPER,
    Series,
    floor_div,
    micros,
)

POSITION = "__position"
RUN_ROW = "__run_row"
Stage = Callable[[WindowSpec], Mapping[str, Column]]


def with_halo(df: DataFrame, s: Series, before: int, after: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the block id, plus copies of rows within ``before``/``after`` rows of other blocks.

    Rows that already carry ``POSITION`` (every row of the series, see
    ``positions``) are not numbered again.  On a regular grid the reach is ``rows * step`` of time and one shuffle is
    enough.  On irregular series blocks are cut by exact row position, so the
    reach in rows is exact whatever the spacing.
    """
    if s.step:
        return with_time_halo(df, s, before * s.step, after * s.step, s.block_micros(rows))
    if POSITION in df.columns:
        return _copy_to_blocks(df, F.col(POSITION), rows, before, after)
    return _copy_to_blocks(positions(df, s, POSITION), F.col(POSITION), rows, before, after).drop(POSITION)


def with_time_halo(df: DataFrame, s: Series, before_s: float, after_s: float, size: int | None = None) -> DataFrame:
    """Like ``with_halo`` with the reach in seconds; always a single shuffle."""
    before, after = int(before_s * MICROS), int(after_s * MICROS)
    # blocks much longer than the reach, so that few rows are copied
    return _copy_to_blocks(df, micros(s.ts), size or max(s.block_micros(), 16 * (before + after)), before, after)


def _copy_to_blocks(df: DataFrame, at: Column, size: int, before: int, after: int) -> DataFrame:
    """Rows keyed by block, with a copy in each other block whose frames reach them."""
    own = floor_div(at, size)
    if before == after == 0:
        return df.withColumns({BLOCK: own, OWNED: F.lit(True)})
    reach = F.sequence(floor_div(at - after, size), floor_div(at + before, size))
    d = df.drop(BLOCK).withColumn("__own", own).withColumn(BLOCK, F.explode(reach))
    return d.withColumn(OWNED, F.col(BLOCK) == F.col("__own")).drop("__own")


def rolling(
    df: DataFrame,
    s: Series,
    before: int,
    after: int,
    *stages: Stage,
    rows: int = BLOCK_ROWS,
    keep_block: bool = False,
    in_seconds: bool = False,
) -> DataFrame:
    """Apply window stages whose frames together reach ``before``/``after`` rows (or seconds)."""
    if in_seconds:
        d = with_time_halo(df, s, before, after)
    else:
        d = with_halo(df, s, before, after, rows)
    w = s.window()
    for stage in stages:
        d = d.withColumns(dict(stage(w)))
    d = d.filter(OWNED).drop(OWNED, *[c for c in d.columns if c.startswith(RUN_ROW)])
    return d if keep_block else d.drop(BLOCK)


_FOLD = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
_LOCAL = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(local, carried)
    if kind == "min":
        return F.least(local, carried)
    return F.coalesce(local + carried, local, carried)


def _carried(totals: DataFrame, keys: Sequence[str], kinds: Mapping[str, str], back: set[str], two_level: bool) -> DataFrame:
    """``keys, block, __c_<n>``: fold of the totals of all earlier (for ``back``: later) blocks.

    With two levels, blocks are first folded inside super-blocks and super-blocks
    inside the series, so no task sees all blocks of one key.
    """
    def fold(d: DataFrame, part: Sequence[str], order: str, src: str, dst: str) -> DataFrame:
        w = {b: Window.partitionBy(*part).orderBy(F.desc(order) if b else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1) for b in (False, True)}
        return d.withColumns({f"{dst}{n}": _FOLD[k](f"{src}{n}").over(w[n in back]) for n, k in kinds.items()})

    if not two_level:
        return fold(totals, keys, BLOCK, "__t_", "__c_").drop(*[f"__t_{n}" for n in kinds])
    d = totals.withColumn(SUPER, floor_div(F.col(BLOCK), BLOCKS_PER_SUPER))
    top = d.groupBy(*keys, SUPER).agg(*[_FOLD[k](f"__t_{n}").alias(f"__t_{n}") for n, k in kinds.items()])
    top = fold(top, keys, SUPER, "__t_", "__u_").drop(*[f"__t_{n}" for n in kinds])
    d = fold(d, [*keys, SUPER], BLOCK, "__t_", "__i_").join(top, [*keys, SUPER], "left")
    return d.select(*keys, BLOCK, *[_combine(k, F.col(f"__i_{n}"), F.col(f"__u_{n}")).alias(f"__c_{n}") for n, k in kinds.items()])


def running(
    df: DataFrame,
    s: Series,
    exprs: Mapping[str, tuple[str, Column]],
    backward: Mapping[str, tuple[str, Column]] | None = None,
    backward_tie: tuple[str, ...] | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Running ``max``/``min``/``sum``/``count`` from the start and, for ``backward``, from the end.

    Frames include the current row.  An existing block column is reused, so this
    follows ``rolling(..., keep_block=True)`` without another shuffle of the rows;
    only the per-block totals move.  Both directions share one pass of totals.
    ``backward_tie`` orders rows of one timestamp differently in that direction.
    """
    back = dict(backward or {})
    both = {**exprs, **back}
    bs = s if backward_tie is None else replace(s, tie=backward_tie)
    fresh = BLOCK not in df.columns
    d = df.withColumn(BLOCK, s.time_block()) if fresh else df
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    totals = d.groupBy(*s.keys, BLOCK).agg(*[_LOCAL[k](c).alias(f"__t_{n}") for n, (k, c) in both.items()])
    carried = _carried(totals, s.keys, {n: k for n, (k, _) in both.items()}, set(back), two_level=fresh and not s.step)
    d = d.withColumns({
        f"__l_{n}": _LOCAL[k](c).over(upto(bs.window(reverse=True) if n in back else s.window())) for n, (k, c) in both.items()
    })
    d = d.join(carried, [*s.keys, BLOCK], "left")
    d = d.withColumns({n: _combine(k, F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n, (k, _) in both.items()})
    d = d.drop(*[f"__{p}_{n}" for n in both for p in "lc"])
    return d if keep_block else d.drop(BLOCK)


def positions(df: DataFrame, s: Series, name: str = "pos") -> DataFrame:
    """Zero-based row number of each row inside its series."""
    d = running(df.drop(BLOCK), s.with_step(None) if not s.step else s, {name: ("count", F.lit(1))})
    return d.withColumn(name, F.col(name) - 1)


def run_starts(
    df: DataFrame, s: Series, flag: Column, name: str = "run", max_gap: float | None = None
) -> DataFrame:
    """Keep the rows where ``flag`` holds and name each run by its first timestamp.

    A run also ends where two rows are more than ``max_gap`` seconds apart.
    """
    f = F.coalesce(flag, F.lit(False))
    prev = lambda c, w: F.lag(c).over(w)

    def breaks(w: WindowSpec) -> dict[str, Column]:
        new = ~F.coalesce(prev(F.col("__f"), w), F.lit(False))
        if max_gap is not None:
            new = new | (micros(s.ts) - prev(micros(s.ts), w) > int(max_gap * MICROS))
        return {"__new": new}

    d = df.withColumn("__f", f)
    if max_gap is not None:
        # a row further back than the gap ends the run whatever its flag, so a reach in time is exact
        d = rolling(d, s, max_gap, 0, breaks, keep_block=True, in_seconds=True)
    else:
        d = rolling(d, s, 1, 0, breaks, keep_block=True)
    d = running(d.filter("__f"), s, {name: ("max", F.when(F.col("__new"), F.col(s.ts)))})
    return d.drop("__f", "__new")


def episodes(
    df: DataFrame,
    s: Series,
    flag: Column,
    aggs: Sequence[Column] = (),
    max_gap: float | None = None,
) -> DataFrame:
    """One row per run of ``flag``: start, end, number of rows and the given aggregates."""
    d = run_starts(df, s, flag, "start_time", max_gap)
    return d.groupBy(*s.keys, "start_time").agg(
        F.max(s.ts).alias("end_time"), F.count(F.lit(1)).alias("n_rows"), *aggs
    )


def run_stages(s: Series, flags: Mapping[str, tuple[Column, int]]) -> tuple[Stage, Stage, Stage]:
    """Stages for ``rolling`` that tell ``{out: (flag, n)}``: whether a row lies in a run of ``flag`` of at least ``n`` rows.

    Only ``n - 1`` rows to each side decide, so pass that reach. A run is measured by the numbers of the last false row
    before and the next one after, so the state of a row does not grow with ``n``. Flags must be non-null.
    """
    part = Window.partitionBy(*s.keys, BLOCK)
    ahead = part.orderBy(RUN_ROW).rowsBetween(Window.unboundedPreceding, 0)
    back = part.orderBy(F.desc(RUN_ROW)).rowsBetween(Window.unboundedPreceding, 0)

    def edges(_: WindowSpec) -> dict[str, Column]:
        out = {}
        for k, (flag, _n) in enumerate(flags.values()):
            off = F.when(~flag, F.col(RUN_ROW))
            out[f"{RUN_ROW}_from_{k}"] = F.coalesce(F.max(off).over(ahead), F.lit(0))
            out[f"{RUN_ROW}_to_{k}"] = F.coalesce(F.min(off).over(back), F.max(RUN_ROW).over(back) + 1)
        return out

    def long_enough(_: WindowSpec) -> dict[str, Column]:
        return {o: flag & (F.col(f"{RUN_ROW}_to_{k}") - F.col(f"{RUN_ROW}_from_{k}") > n) for k, (o, (flag, n)) in enumerate(flags.items())}

    return lambda w: {RUN_ROW: F.row_number().over(w)}, edges, long_enough


def bridge(flag: Column, n: int, w: WindowSpec) -> Column:
    """``flag`` with false runs of at most ``n`` rows between two true rows set to true; needs a reach of ``n`` rows."""
    if n <= 0:
        return flag
    before = F.array_position(F.reverse(F.collect_list(flag).over(w.rowsBetween(-n, -1))), F.lit(True))
    after = F.array_position(F.collect_list(flag).over(w.rowsBetween(1, n)), F.lit(True))
    return flag | ((before > 0) & (after > 0) & (before + after - 1 <= n))
