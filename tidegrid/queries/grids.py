"""Queries for resampling, grids and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import grid, joins
from tidegrid.plans.series import Series
from tidegrid.queries.inputs import (
    staged, EVENTS_SQL, HALF, HALF_SQL, PLANT, PLANT_SQL, RAW, STEP, TWO, events, half, plant, two_decimals,
)
from tidegrid.queries.registry import query

SLOT = "event_type, time_bucket(INTERVAL '30 minutes', ts) AS ts"
HOURLY = "date_trunc('hour', ts)"


def stamped(spark, sf):
    """Mean of events per half hour, only the stamps that have events."""
    return grid.resample(events(spark, sf), HALF, STEP, {"v": F.avg("value"), "n": F.count(F.lit(1))})


@query("c01_regular_grid", f"""
WITH b AS (SELECT {SLOT}, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM b GROUP BY 1)
SELECT event_type, ts, round(v, 8) AS v, n FROM g LEFT JOIN b USING (event_type, ts)""", digits=8)
def c01(spark, sf):
    return grid.regular_grid(stamped(spark, sf), HALF, STEP)


@query("c01_missing_timestamp_rate", f"""
WITH b AS (SELECT DISTINCT {SLOT} FROM events),
m AS (SELECT event_type, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1800000000 + 1 AS BIGINT) AS expected, count(*) AS present FROM b GROUP BY 1)
SELECT *, round(100.0 * (expected - present) / expected, 6) AS missing_rate FROM m""")
def c01_rate(spark, sf):
    return grid.missing_timestamp_rate(stamped(spark, sf), HALF, STEP)


@query("c02_resample_mean", f"""
WITH {EVENTS_SQL}, b AS (SELECT {SLOT}, avg(value) AS value, avg(k) AS k FROM ev GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM b GROUP BY 1)
SELECT event_type, ts, round(value, 8) AS value, round(k, 8) AS k FROM g LEFT JOIN b USING (event_type, ts)""", digits=8)
def c02(spark, sf):
    return grid.resample_mean(events(spark, sf), HALF, STEP, ["value", "k"])


@query("c03_role_resample", f"""
WITH {EVENTS_SQL}, r AS (SELECT event_type, ts, value AS temp, CASE WHEN k < 80 THEN k END AS setpoint FROM ev),
b AS (SELECT {SLOT}, avg(temp) AS temp FROM r GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM b GROUP BY 1)
SELECT g.event_type, g.ts, round(b.temp, 8) AS temp, r.setpoint FROM g LEFT JOIN b USING (event_type, ts)
ASOF LEFT JOIN r ON g.event_type = r.event_type AND g.ts >= r.ts""", digits=8)
def c03(spark, sf):
    d = events(spark, sf).select("event_type", "ts", F.col("value").alias("temp"), F.when(F.col("k") < 80, F.col("k")).alias("setpoint"))
    return grid.role_resample(d, HALF, STEP, ["temp", "setpoint"])


@query("c04_hourly_mean", f"""
WITH {HALF_SQL} SELECT event_type, {HOURLY} AS ts, round(avg(v), 8) AS v, round(avg(k), 8) AS k FROM half WHERE k IS NULL OR k > 20
GROUP BY 1, 2 HAVING count(v) + count(k) > 0""", digits=8)
def c04_mean(spark, sf):
    return grid.aggregate_time(half(spark, sf), HALF, "hour", ["v", "k"], "mean", F.col("k").isNull() | (F.col("k") > 20))


@query("c04_daily_median", f"""
WITH {HALF_SQL} SELECT event_type, date_trunc('day', ts) AS ts, round(quantile_cont(v, 0.5), 7) AS v FROM half
GROUP BY 1, 2 HAVING count(v) > 0""", digits=7)
def c04_median(spark, sf):
    return grid.aggregate_time(half(spark, sf), HALF, "day", ["v"], "median")


@query("c05_daily_mean", """
SELECT event_type, CAST(ts AS DATE) AS date, round(avg(value), 8) AS value FROM events GROUP BY 1, 2""", digits=8)
def c05(spark, sf):
    return grid.daily_mean(events(spark, sf), RAW, ["value"])


CARPET = f"""WITH {EVENTS_SQL},
c AS (SELECT event_type, CAST(ts AS DATE) AS date, hour(ts) AS hour, %s AS value FROM ev GROUP BY 1, 2, 3),
d AS (SELECT event_type, unnest(generate_series(CAST(min(date) AS TIMESTAMP), max(date) + INTERVAL '23 hours', INTERVAL '1 hour')) AS t FROM c GROUP BY 1),
g AS (SELECT event_type, CAST(t AS DATE) AS date, hour(t) AS hour FROM d)
"""


@query("c06_carpet_mean", CARPET % "avg(value)" + """
SELECT g.event_type, g.date, CAST(g.hour AS INT) AS hour, round(value, 8) AS value FROM g LEFT JOIN c USING (event_type, date, hour)""", digits=8)
def c06_mean(spark, sf):
    return grid.carpet(events(spark, sf), RAW, "value")


@query("c06_carpet_median", CARPET % "quantile_cont(k, 0.5)" + """
SELECT g.event_type, g.date, CAST(g.hour AS INT) AS hour, value FROM g LEFT JOIN c USING (event_type, date, hour)""")
def c06_median(spark, sf):
    return grid.carpet(events(spark, sf).withColumnRenamed("k", "fan_speed"), RAW, "fan_speed")


@query("c06_carpet_coverage", CARPET % "avg(value)" + """
SELECT event_type, count(*) AS cells, round(100.0 * count(value) / count(*), 6) AS coverage_pct FROM g LEFT JOIN c USING (event_type, date, hour) GROUP BY 1""")
def c06_coverage(spark, sf):
    return grid.coverage(grid.carpet(events(spark, sf), RAW, "value"), ["event_type"])


def weather(spark, sf):
    """Hourly mean of one event type, standing in for a weather station without keys."""
    d = events(spark, sf).filter("event_type = 'signup'")
    return grid.resample(d, Series(), 3600, {"temp": two_decimals(F.avg("value"))})


WEATHER_SQL = f"weather AS (SELECT {HOURLY} AS ts, {TWO % 'avg(value)'} AS temp FROM events WHERE event_type = 'signup' GROUP BY 1)"


@query("d01_weather_exact_join", f"""
WITH {HALF_SQL}, {WEATHER_SQL} SELECT event_type, half.ts, v, temp, weather.ts IS NOT NULL AS matched FROM half LEFT JOIN weather ON half.ts = weather.ts""")
def d01(spark, sf):
    return joins.exact_join(half(spark, sf).select("event_type", "ts", "v"), weather(spark, sf), ["ts"], ["temp"])


@query("d01_match_rate", f"""
WITH {HALF_SQL}, {WEATHER_SQL} SELECT event_type, count(*) AS n_rows, round(100.0 * count(weather.ts) / count(*), 6) AS match_rate
FROM half LEFT JOIN weather ON half.ts = weather.ts GROUP BY 1""")
def d01_rate(spark, sf):
    return joins.match_rate(joins.exact_join(half(spark, sf), weather(spark, sf), ["ts"], ["temp"]), ["event_type"])


BY_USER = Series(("user_id",), "ts")
NEAREST_SQL = """l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
b AS (SELECT l.*, r.ts AS bts, r.value AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts),
f AS (SELECT b.*, r.ts AS fts, r.value AS fv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.ts <= r.ts),
n AS (SELECT user_id, ts, event_id, CASE WHEN fts IS NULL OR epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts) THEN bts ELSE fts END AS at_ts,
  CASE WHEN fts IS NULL OR epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts) THEN bv ELSE fv END AS value FROM f)"""


def _sides(spark, sf):
    ev = events(spark, sf)
    left = ev.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return left, ev.filter("event_type = 'view'").select("user_id", "ts", "value")


@query("d02_nearest_join", f"""
WITH {NEAREST_SQL} SELECT user_id, ts, event_id, CASE WHEN abs(epoch_us(ts) - epoch_us(at_ts)) <= 86400000000 THEN value END AS value FROM n""")
def d02(spark, sf):
    return joins.nearest_join(*_sides(spark, sf), BY_USER, ["value"], 86_400)


@query("d02_two_step_join", f"""
WITH {HALF_SQL}, {WEATHER_SQL},
l AS (SELECT event_type, ts, v FROM half),
b AS (SELECT l.*, w.ts AS bts, w.temp AS bv FROM l ASOF LEFT JOIN weather w ON l.ts >= w.ts),
f AS (SELECT b.*, w.ts AS fts, w.temp AS fv FROM b ASOF LEFT JOIN weather w ON b.ts <= w.ts),
n AS (SELECT event_type, ts, v, CASE WHEN fts IS NULL OR epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts) THEN bts ELSE fts END AS at_ts,
  CASE WHEN fts IS NULL OR epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts) THEN bv ELSE fv END AS temp FROM f),
rate AS (SELECT 100.0 * count(*) FILTER (ts = at_ts) / count(*) AS r FROM n)
SELECT event_type, ts, v, CASE WHEN ts = at_ts OR (r <= 80 AND abs(epoch_us(ts) - epoch_us(at_ts)) <= 1800000000) THEN temp END AS temp FROM n, rate""")
def d02_two_step(spark, sf):
    left = staged(half(spark, sf)).select("event_type", "ts", "v")
    return joins.two_step_join(left, weather(spark, sf), Series(), ["temp"], 1800)


@query("d03_align_flags", f"""
WITH {HALF_SQL}, f AS (SELECT {SLOT}, 1 AS hot FROM events GROUP BY 1, 2 HAVING max(value) > 150)
SELECT event_type, ts, v, coalesce(hot, 0) AS hot FROM half LEFT JOIN f USING (event_type, ts)""")
def d03(spark, sf):
    flags = grid.resample(events(spark, sf), HALF, STEP, {"mx": F.max("value")}).filter("mx > 150").withColumn("hot", F.lit(1))
    return joins.align_flags(half(spark, sf).select("event_type", "ts", "v"), flags, ["event_type", "ts"], ["hot"])


@query("d04_backward_lookup", """
WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT l.user_id, l.ts, event_id, value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def d04(spark, sf):
    return joins.backward_lookup(*_sides(spark, sf), BY_USER, ["value"])


@query("d05_lookup_filled", f"""
WITH {HALF_SQL} SELECT event_type, ts, coalesce(
  last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM half""")
def d05(spark, sf):
    d = staged(half(spark, sf))
    return joins.lookup_filled(d.select("event_type", "ts"), d.filter("v IS NOT NULL"), HALF, ["v"])


@query("d06_context_window", f"""
WITH {HALF_SQL} SELECT a.event_type, a.ts AS anchor_ts, h.ts, h.v FROM half a JOIN half h
  ON a.event_type = h.event_type AND h.ts BETWEEN a.ts - INTERVAL '2 hours' AND a.ts + INTERVAL '2 hours' WHERE a.v > 200""")
def d06(spark, sf):
    d = half(spark, sf).select("event_type", "ts", "v")
    anchors = d.filter("v > 200").select("event_type", F.col("ts").alias("anchor_ts"))
    return joins.context(anchors, d, HALF, 7200).select("event_type", "anchor_ts", "ts", "v")


@query("d07_near_gap_boundary", f"""
WITH {HALF_SQL}, m AS (SELECT *, lag(v IS NULL) OVER w AS p, lead(v IS NULL) OVER w AS x FROM half WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
e AS (SELECT event_type, ts FROM m WHERE v IS NULL AND (p IS DISTINCT FROM true OR x IS DISTINCT FROM true))
SELECT event_type, ts, v, v IS NULL AS removed, EXISTS (SELECT 1 FROM e WHERE e.event_type = half.event_type
  AND e.ts BETWEEN half.ts - INTERVAL '1 hour' AND half.ts + INTERVAL '1 hour') AS near_gap FROM half""")
def d07(spark, sf):
    from tidegrid.plans.blocks import episodes

    d = staged(half(spark, sf)).select("event_type", "ts", "v")
    gaps = episodes(d, HALF, F.col("v").isNull())
    edges = gaps.select("event_type", F.explode(F.array("start_time", "end_time")).alias("boundary_ts"))
    out = joins.near_boundary(d, edges, HALF, 2 * STEP)
    return joins.in_set(out, d.filter("v IS NULL"), ["event_type", "ts"], "removed")


@query("d08_report_assembly", f"""
WITH {PLANT_SQL}, u AS (UNPIVOT plant ON tm, tr, tc INTO NAME feature VALUE v),
s AS (SELECT feature, avg(v) AS mean, count(v) AS n FROM u GROUP BY 1), t AS (SELECT feature, min(v) AS lo FROM u GROUP BY 1)
SELECT feature, round(mean, 8) AS mean, n, lo FROM s LEFT JOIN t USING (feature)""", digits=8)
def d08(spark, sf):
    from tidegrid.operators.importance import assemble
    from tidegrid.plans.quantiles import melt

    u = melt(plant(spark, sf), [], ["tm", "tr", "tc"]).withColumnRenamed("variable", "feature")
    a = u.groupBy("feature").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return assemble(a, u.groupBy("feature").agg(F.min("value").alias("lo")))


@query("d09_index_intersection", f"""
WITH {PLANT_SQL} SELECT ts, tm, tout FROM plant WHERE tm IS NOT NULL AND tout IS NOT NULL""")
def d09(spark, sf):
    return joins.common_index(plant(spark, sf), "ts", ["tm", "tout"])


@query("d10_holiday_mask", """
WITH h AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE value > 280)
SELECT event_id, h.d IS NOT NULL AS is_holiday, CASE WHEN h.d IS NOT NULL THEN 0 ELSE 1 END AS occupied
FROM events LEFT JOIN h ON CAST(ts AS DATE) = h.d""")
def d10(spark, sf):
    ev = events(spark, sf)
    d = ev.select("event_id", "ts", F.lit(1).alias("occupied"))
    return joins.holiday_mask(d, "ts", ev.filter("value > 280").select("ts"), "ts", "occupied").drop("ts")


@query("d11_previous_period", f"""
WITH {HALF_SQL} SELECT a.event_type, a.ts, count(b.v) AS n_prev, round(quantile_cont(b.v, 0.5), 7) AS median_prev FROM half a LEFT JOIN half b
  ON a.event_type = b.event_type AND b.ts BETWEEN a.ts - INTERVAL '25 hours' AND a.ts - INTERVAL '23 hours' GROUP BY 1, 2""", digits=7)
def d11(spark, sf):
    d = joins.one_period_back(half(spark, sf), HALF, 86_400, 3600, {"n_prev": F.count("v"), "median_prev": F.percentile("v", 0.5)})
    return d.select("event_type", "ts", "n_prev", "median_prev")
