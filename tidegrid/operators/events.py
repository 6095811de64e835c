"""From window flags to events, episodes and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.columns import false_if_null
from tidegrid.operators.joins import in_set, near_boundary
from tidegrid.plans.blocks import bridge, episodes, positions, rolling, run_stages, running
from tidegrid.plans.series import MICROS, Series, micros

# Order of severities, weights of the candidate score, shortest step in hours.
SEVERITY_RANK = ("Normal", "Minor", "Moderate", "Critical")
CANDIDATE_WEIGHTS = {"max_exceedance": 0.45, "mean_exceedance": 0.30, "duration_h": 0.15, "mean_features": 0.10}
MIN_STEP_H = 0.5


def event_rows(df: DataFrame, s: Series, flag: str, step_h: float, min_len: int = 3, bridge_len: int = 2, merge_hours: float = 1.0, carry: Sequence[str] = ()) -> DataFrame:
    """Rows that belong to an event, named by ``event_start``.

    Short holes are bridged, short runs dropped, and runs at most ``merge_hours``
    apart joined; rows are never closer than ``step_h``, so all of this looks a
    bounded number of rows back.  ``__prev_<c>`` is the value of the event's
    row before.
    """
    merge_rows = ceil(merge_hours / step_h)
    reach = bridge_len + min_len
    at = micros(s.ts)

    def earlier(w):
        back = w.rowsBetween(-merge_rows, -1)
        prev = F.last(F.when(F.col("__k"), F.struct(at.alias("t"), *carry)), True).over(back)
        return {"__adjacent": false_if_null(F.lag("__k").over(w)), "__p": prev}

    d = rolling(
        df.withColumn("__f", false_if_null(F.col(flag))), s, reach + merge_rows + 1, reach,
        lambda w: {"__b": bridge(F.col("__f"), bridge_len, w)},
        *run_stages(s, {"__k": (F.col("__b"), min_len)}),
        earlier, keep_block=True,
    )
    near = false_if_null(at - F.col("__p.t") <= int(merge_hours * 3600 * MICROS))
    new = ~(F.col("__adjacent") | near)
    prev = {f"__prev_{c}": F.when(~F.col("__new"), F.col(f"__p.{c}")) for c in carry}
    d = d.filter("__k").withColumn("__new", new).withColumns(prev)
    d = running(d, s, {"event_start": ("max", F.when(F.col("__new"), F.col(s.ts)))})
    return d.drop("__f", "__b", "__k", "__adjacent", "__p", "__new")


def events(
    df: DataFrame, s: Series, flag: str, score: str, label: str, severity: str, step_h: float,
    supply: str | None = None, ret: str | None = None, coil: str | None = None, min_len: int = 3, bridge_len: int = 2, merge_hours: float = 1.0,
) -> DataFrame:
    """One row per event with its type, highest severity, extent, peak and physical figures, numbered by start."""
    phys = all((supply, ret, coil))
    d = event_rows(df, s, flag, step_h, min_len, bridge_len, merge_hours, [supply] if phys else [])
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITY_RANK]), F.when(F.col(severity) == "Anomaly", "Minor").otherwise(F.col(severity)))
    aggs = [
        F.max(F.col(label) == "Potential fault").alias("__fault"),
        F.max_by(severity, rank).alias("severity"), F.max(s.ts).alias("end"), F.count(F.lit(1)).alias("n_windows"),
        F.max(score).alias("peak_score"), F.max_by(s.ts, F.struct(F.col(score), -micros(s.ts))).alias("peak_ts"),
    ]
    if phys:
        aggs += [
            F.avg(F.abs(F.col(supply) - F.col(coil))).alias("supply_coil_mean_abs"), F.avg(F.abs(F.col(supply) - F.col(ret))).alias("supply_return_mean_abs"),
            F.coalesce(F.max(F.abs(F.col(supply) - F.col(f"__prev_{supply}"))), F.lit(0.0)).alias("supply_change_max"),
        ]
    e = d.groupBy(*s.keys, "event_start").agg(*aggs).withColumnRenamed("event_start", "start")
    e = e.withColumns({
        "event_type": F.when(F.col("__fault"), "Potential fault").otherwise("Operational transient"),
        "duration_h": F.col("n_windows") * max(step_h, MIN_STEP_H),
    }).drop("__fault")
    numbered = positions(e, Series(s.keys, "start", None, (), s.span), "event_id")
    return numbered.withColumn("event_id", F.col("event_id") + 1)


def episode_stats(df: DataFrame, s: Series, flag: str, step_h: float) -> DataFrame:
    """Number of contiguous flagged runs, mean and longest length in windows and hours."""
    e = episodes(df, s, F.col(flag))
    g = e.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n_episodes"), F.avg("n_rows").alias("mean_windows"), F.max("n_rows").alias("max_windows"))
    return g.withColumns({"mean_hours": F.col("mean_windows") * step_h, "max_hours": F.col("max_windows") * step_h})


def gap_diagnostic(df: DataFrame, s: Series, flag: str, gaps: DataFrame, removed: DataFrame, step_s: int, steps: int = 2) -> DataFrame:
    """Flags inside removed stamps or within ``steps`` of a gap boundary, against all flags."""
    edges = gaps.select(*s.keys, F.explode(F.array("start_time", "end_time")).alias("boundary_ts"))
    d = near_boundary(df.filter(F.col(flag)).select(*s.keys, s.ts), edges, s, steps * step_s)
    d = in_set(d, removed, [*s.keys, s.ts], "__removed")
    near = F.col("near_gap") | F.col("__removed")
    g = d.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n_anomalies"), F.count_if(near).alias("n_gap_adjacent"))
    return g.withColumns({
        "gap_adjacent_pct": 100.0 * F.col("n_gap_adjacent") / F.col("n_anomalies"), "n_genuine": F.col("n_anomalies") - F.col("n_gap_adjacent")})


def candidate_events(df: DataFrame, s: Series, flag: str, score: str, threshold: str, n_features: str, step_h: float = 0.5) -> DataFrame:
    """Runs of candidate flags with exceedance figures and a ranking score."""
    exceed = F.greatest(F.col(score) - F.col(threshold), F.lit(0.0))
    e = episodes(df, s, F.col(flag), [
        F.max(score).alias("peak_score"), F.max_by(threshold, F.struct(F.col(score), -micros(s.ts))).alias("peak_threshold"),
        F.max(exceed).alias("max_exceedance"), F.avg(exceed).alias("mean_exceedance"), F.avg(n_features).alias("mean_features"),
    ])
    e = e.withColumns({"duration_h": F.col("n_rows") * step_h, "start_hour": F.hour("start_time"), "end_hour": F.hour("end_time")})
    value = F.lit(0.0)
    for c, w in CANDIDATE_WEIGHTS.items():
        value = value + w * F.col(c)
    return e.withColumn("candidate_score", value)


def ranked(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """Candidates from the highest score down."""
    d = candidates.orderBy(F.desc("candidate_score"), F.desc("max_exceedance"), F.desc("duration_h"), "start_time")
    return d.limit(n) if n else d


def result_table(df: DataFrame, evs: DataFrame, s: Series, rules: Sequence[str] = (), flag: str = "kept") -> DataFrame:
    """Scored rows with the event they fall in and the conjunction of flag and rules."""
    e = evs.select(*s.keys, F.col("start").alias(s.ts), F.struct("end", "event_id", "event_type").alias("__e"))
    # the latest event that starts at or before the row, if it has not ended
    starts = df.join(e, [*s.keys, s.ts], "left")
    key = F.when(F.col("__e").isNotNull(), F.struct(F.col(s.ts).alias("at"), F.col("__e").alias("e")))
    d = running(starts, s, {"__cur": ("max", key)})
    inside = F.col(s.ts) <= F.col("__cur")["e"]["end"]
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | F.col(r)
    return d.withColumns({
        "event_id": F.coalesce(F.when(inside, F.col("__cur")["e"]["event_id"]), F.lit(0)),
        "event_type": F.coalesce(F.when(inside, F.col("__cur")["e"]["event_type"]), F.lit("None")),
        "anomaly_and_rule": F.col(flag) & any_rule,
    }).drop("__e", "__cur")

