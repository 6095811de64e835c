"""Queries for feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import features
from tidegrid.queries.inputs import HALF, HALF_SQL, PLANT, PLANT_SQL, half, plant, staged
from tidegrid.queries.registry import query

W = "(PARTITION BY event_type ORDER BY ts)"


def full(spark, sf):
    """The keyed series with missing values as 0, for operators that need every row."""
    return half(spark, sf).fillna(0.0, ["v", "k"])


FULL_SQL = f"{HALF_SQL}, full_ AS (SELECT event_type, ts, coalesce(v, 0) AS v, coalesce(k, 0) AS k FROM half)"


@query("h01_delta_t", f"WITH {PLANT_SQL} SELECT ts, round(tm - tr, 6) AS delta_t_signed FROM plant")
def h01(spark, sf):
    return features.delta_t(plant(spark, sf), "tm", "tr").select("ts", "delta_t_signed")


@query("h02_calendar", f"WITH {HALF_SQL} SELECT event_type, ts, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM half")
def h02(spark, sf):
    return features.calendar(half(spark, sf).select("event_type", "ts"), "ts")


@query("h03_season_progress", f"""
WITH {HALF_SQL} SELECT event_type, ts, round(greatest(0, least(1, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03 06:00:00')) / 86400000000) / 20)), 6) AS season_progress FROM half""")
def h03(spark, sf):
    return features.season_progress(half(spark, sf).select("event_type", "ts"), "ts", "2024-01-03 06:00:00", "2024-01-23 12:00:00")


_CYC = ", ".join(
    f"CASE WHEN abs({fn}(2 * pi() * {c} / {n})) < 1e-9 THEN 0.0 ELSE round({fn}(2 * pi() * {c} / {n}), 6) END AS {name}_{fn}" for fn in ("sin", "cos")
    for name, c, n in (("hour", "hour(ts)", 24), ("day_of_week", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12), ("day_of_year", "dayofyear(ts)", 365)))


@query("h04_cyclic_encoding", f"WITH {HALF_SQL} SELECT event_type, ts, {_CYC} FROM half")
def h04(spark, sf):
    return features.cyclic(half(spark, sf).select("event_type", "ts"), "ts")


OCC = """CAST((isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) >= 360 AND hour(ts) * 60 + minute(ts) < 1080)
  OR (isodow(ts) = 6 AND hour(ts) * 60 + minute(ts) >= 360 AND hour(ts) * 60 + minute(ts) < 840) AS INT)"""


@query("h05_occupancy", f"WITH {HALF_SQL} SELECT event_type, ts, {OCC} AS is_occupied FROM half")
def h05(spark, sf):
    return features.occupied(half(spark, sf).select("event_type", "ts"), "ts", saturday=True)


@query("h06_startup_shutdown", f"""
WITH {HALF_SQL}, o AS (SELECT event_type, ts, {OCC} AS is_occupied FROM half), c AS (SELECT *, is_occupied - lag(is_occupied) OVER {W} AS c FROM o)
SELECT event_type, ts, is_occupied,
 CAST(coalesce(max(CASE WHEN c = 1 THEN 1 END) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '30 minutes' PRECEDING AND INTERVAL '30 minutes' FOLLOWING), 0) AS INT) AS is_startup,
 CAST(coalesce(max(CASE WHEN c = -1 THEN 1 END) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1 hour' PRECEDING AND INTERVAL '1 hour' FOLLOWING), 0) AS INT) AS is_shutdown FROM c""")
def h06(spark, sf):
    return features.startup_shutdown(h05(spark, sf), HALF, startup_h=1.0, shutdown_h=2.0)


@query("h07_active_operation", f"WITH {HALF_SQL} SELECT event_type, ts, CAST(coalesce(v >= 60, false) OR coalesce(k >= 60, false) AS INT) AS is_active_operation FROM half")
def h07(spark, sf):
    return features.active_operation(half(spark, sf), "v", "k", 60.0).select("event_type", "ts", "is_active_operation")


@query("h08_rolling_means", f"""
WITH {HALF_SQL} SELECT event_type, ts, round(avg(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 8) AS rolling_3h,
 round(avg(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), 8) AS rolling_24h FROM half""", digits=8)
def h08(spark, sf):
    d = features.rolling_means(half(spark, sf), HALF, "v", {"rolling_3h": 6, "rolling_24h": 48})
    return d.select("event_type", "ts", "rolling_3h", "rolling_24h")


@query("h09_setpoint_error", f"WITH {HALF_SQL} SELECT event_type, ts, round(CASE WHEN abs(v - k) > 3 THEN v - k ELSE 0 END, 6) AS setpoint_error FROM half")
def h09(spark, sf):
    d = half(spark, sf).withColumnsRenamed({"v": "Temperatura Mandata", "k": "Set Points Raffreddamento"})
    sp = features.season_setpoint("summer", d.columns)
    return features.setpoint_error(d, "Temperatura Mandata", sp, 3.0).select("event_type", "ts", "setpoint_error")


@query("h10_control_features", f"""
WITH {HALF_SQL}, e AS (SELECT event_type, ts, v - k AS e FROM half)
SELECT event_type, ts, round(e, 6) AS setpoint_error, round(e - lag(e) OVER {W}, 6) AS setpoint_error_rate, CAST(coalesce(abs(e) > 5, false) AS INT) AS out_of_tolerance, round(abs(e), 6) AS abs_setpoint_error, round(e * e, 6) AS squared_setpoint_error,
 round(CASE WHEN e IS NOT NULL THEN sum(e) OVER {W} END, 6) AS cumulative_setpoint_error, CAST(sum(CAST(coalesce(abs(e) > 5, false) AS INT)) OVER {W} AS BIGINT) AS time_out_of_tolerance FROM e""")
def h10(spark, sf):
    d = staged(half(spark, sf)).select("event_type", "ts", (F.col("v") - F.col("k")).alias("setpoint_error"))
    return features.control_features(d, HALF, tolerance=5.0)


@query("h11_thermal_power", f"WITH {PLANT_SQL} SELECT ts, round((tm - tr) * fan, 6) AS thermal_power_signed FROM plant")
def h11(spark, sf):
    d = features.delta_t(plant(spark, sf), "tm", "tr")
    return features.thermal_power(d, "delta_t_signed", "fan").select("ts", "thermal_power_signed")


@query("h12_first_differences", f"WITH {HALF_SQL} SELECT event_type, ts, round(coalesce(v - lag(v) OVER {W}, 0), 6) AS d_v, round(coalesce(k - lag(k) OVER {W}, 0), 6) AS d_k FROM half")
def h12(spark, sf):
    return features.differences(half(spark, sf), HALF, {"d_v": "v", "d_k": "k"}).drop("v", "k")


@query("h13_rates", f"WITH {HALF_SQL} SELECT event_type, ts, round(v - lag(v) OVER {W}, 6) AS v_rate, round(abs(v - lag(v) OVER {W}), 6) AS v_abs_rate FROM half")
def h13(spark, sf):
    return features.rates(half(spark, sf).select("event_type", "ts", "v"), HALF, ["v"]).drop("v")


@query("h14_lag_features", f"WITH {HALF_SQL} SELECT event_type, ts, " + ", ".join(f"lag({c}, {k}) OVER {W} AS {c}_lag_{k}" for c in "vk" for k in features.LAGS) + " FROM half")
def h14(spark, sf):
    return features.lags(half(spark, sf), HALF, ["v", "k"]).drop("v", "k")


@query("h15_feature_summary", f"""
WITH {PLANT_SQL}, f AS (SELECT tm - tr AS delta_t_signed, CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, CAST(isodow(ts) >= 6 AS DOUBLE) AS is_weekend FROM plant),
u AS (SELECT * FROM f UNPIVOT INCLUDE NULLS (x FOR variable IN (delta_t_signed, hour_of_day, day_of_week, is_weekend)))
SELECT variable, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(x) AS count, round(100.0 * count(x) / count(*), 6) AS filled_pct FROM u GROUP BY 1""")
def h15(spark, sf):
    base = plant(spark, sf)
    return features.feature_summary(features.calendar(features.delta_t(base, "tm", "tr"), "ts"), base.columns)


EWM_SQL = """r AS (SELECT event_type, ts, v, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM full_),
y AS (SELECT event_type, i, v AS y FROM r WHERE i = 1 UNION ALL SELECT r.event_type, r.i, 0.4 * r.v + 0.6 * y.y FROM y JOIN r ON r.event_type = y.event_type AND r.i = y.i + 1)"""


@query("h16_ewma_smoothing", f"WITH RECURSIVE {FULL_SQL}, {EWM_SQL} SELECT event_type, ts, round(y, 8) AS v FROM y JOIN r USING (event_type, i)", digits=8)
def h16(spark, sf):
    return features.ewm_smooth(staged(full(spark, sf)).select("event_type", "ts", "v"), HALF, ["v"], 4.0)


@query("h17_thermal_load", f"""
WITH {PLANT_SQL} SELECT ts, round(abs(tr - tm), 6) AS thermal_load, round(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN tr - tm ELSE tm - tr END, 6) AS delta_t_season FROM plant""")
def h17(spark, sf):
    d = plant(spark, sf).withColumn("season", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "summer").otherwise("winter"))
    return features.thermal_load(d, "tm", "tr", "season").select("ts", "thermal_load", "delta_t_season")
