"""Queries for missing data and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import clean, impute, missing
from tidegrid.queries.inputs import EVENTS_SQL, HALF, HALF_SQL, PLANT, PLANT_SQL, SIGNALS, STEP, half, plant, staged
from tidegrid.queries.registry import query

COLS = ["v", "k"]
ALL = list(SIGNALS)
# long form of the keyed half-hour series and its NULL runs
LONG_SQL = f"""{HALF_SQL},
u AS (SELECT event_type, ts, 'v' AS variable, v AS value FROM half UNION ALL SELECT event_type, ts, 'k', CASE WHEN k > 95 THEN NULL ELSE k END FROM half),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type, variable ORDER BY ts)
     - row_number() OVER (PARTITION BY event_type, variable, value IS NULL ORDER BY ts) AS isl FROM u),
runs AS (SELECT event_type, variable, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_rows,
     (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 AS gap_hours FROM i WHERE value IS NULL GROUP BY event_type, variable, isl)"""


def series(spark, sf):
    return half(spark, sf).withColumn("k", F.when(F.col("k") <= 95, F.col("k")))


def _rating(x):
    return f"CASE WHEN {x} < 1 THEN 'Excellent' WHEN {x} < 5 THEN 'Good' WHEN {x} < 15 THEN 'Fair' WHEN {x} < 30 THEN 'Poor' ELSE 'Critical' END"


@query("e01_missing_summary", f"""
WITH {LONG_SQL}, m AS (SELECT event_type, variable, count(*) AS total, count(*) - count(value) AS missing FROM u GROUP BY 1, 2)
SELECT *, round(100.0 * missing / total, 6) AS missing_pct, {_rating('100.0 * missing / total')} AS rating FROM m""")
def e01(spark, sf):
    return missing.missing_summary(series(spark, sf), ["event_type"], COLS)


@query("e02_missing_periods", f"""
WITH {LONG_SQL}, s AS (SELECT event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) / (count(*) - 1) AS step FROM half GROUP BY 1),
p AS (SELECT r.*, gap_hours + step / 3600000000.0 AS h, make_timestamp(CAST(epoch_us(end_time) + step AS BIGINT)) AS e FROM runs r JOIN s USING (event_type))
SELECT event_type, variable, start_time, e AS end_time, round(h, 6) AS duration_hours, round(h / 24, 6) AS duration_days, n_rows AS missing_records,
  CASE WHEN h < 12 THEN 'Minor' WHEN h < 48 THEN 'Moderate' WHEN h < 168 THEN 'Major' ELSE 'Critical' END AS severity FROM p WHERE h >= 1.5""")
def e02(spark, sf):
    return missing.missing_periods(staged(series(spark, sf)), HALF, COLS, 1.5)


@query("e03_gap_durations", f"WITH {LONG_SQL} SELECT event_type, variable, start_time, end_time, n_rows, round(gap_hours, 6) AS gap_hours FROM runs WHERE gap_hours >= 0.5")
def e03(spark, sf):
    return missing.gap_durations(series(spark, sf), HALF, COLS, 0.5)


@query("e04_gap_histogram", f"""
WITH {LONG_SQL} SELECT event_type, variable, CASE WHEN gap_hours < 0.5 THEN '<30min' WHEN gap_hours < 1 THEN '30min-1h' WHEN gap_hours < 4 THEN '1-4h'
  WHEN gap_hours < 24 THEN '4-24h' ELSE '>24h' END AS gap_class, count(*) AS n_gaps FROM runs GROUP BY 1, 2, 3""")
def e04(spark, sf):
    return missing.gap_histogram(missing.gap_durations(series(spark, sf), HALF, COLS), ["event_type", "variable"])


@query("e04_gap_safety", f"""
WITH {LONG_SQL}, m AS (SELECT event_type, count(*) AS n_gaps, max(gap_hours) AS max_gap_hours, 100.0 * avg(CAST(gap_hours <= 1 AS INT)) AS dummy,
  100.0 * avg(CAST(gap_hours <= 4 AS INT)) AS safe, 100.0 * avg(CAST(gap_hours > 4 AND gap_hours <= 24 AS INT)) AS med,
  100.0 * avg(CAST(gap_hours > 24 AS INT)) AS long FROM runs GROUP BY 1)
SELECT event_type, n_gaps, round(max_gap_hours, 6) AS max_gap_hours, round(safe, 6) AS safe_pct, round(med, 6) AS medium_pct, round(long, 6) AS long_pct,
  CASE WHEN safe > 90 THEN 'safe to interpolate' WHEN safe > 70 THEN 'mostly safe' WHEN safe > 50 THEN 'review medium gaps' ELSE 'many long gaps' END AS verdict FROM m""")
def e04_safety(spark, sf):
    return missing.gap_safety(missing.gap_durations(series(spark, sf), HALF, COLS), ["event_type"])


@query("e05_missing_timestamps", f"""
WITH {LONG_SQL} SELECT event_type, ts, variable, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M:%S') AS time, CAST(hour(ts) AS INT) AS hour_of_day,
  dayname(ts) AS day_of_week, isodow(ts) >= 6 AS is_weekend, hour(ts) BETWEEN 8 AND 17 AS is_working_hours FROM u WHERE value IS NULL""")
def e05(spark, sf):
    return missing.missing_timestamps(series(spark, sf), HALF, COLS)


@query("e06_missing_correlations", f"""
WITH {HALF_SQL}, f AS (SELECT event_type, CAST(v IS NULL AS DOUBLE) AS a, CAST(k IS NULL OR k > 95 AS DOUBLE) AS b, CAST(k IS NULL OR k > 60 AS DOUBLE) AS c FROM half),
p AS (SELECT event_type, 'v' AS variable_1, 'k' AS variable_2, corr(a, b) AS r, count(*) AS n FROM f GROUP BY 1
  UNION ALL SELECT event_type, 'v', 'k2', corr(a, c), count(*) FROM f GROUP BY 1 UNION ALL SELECT event_type, 'k', 'k2', corr(b, c), count(*) FROM f GROUP BY 1)
SELECT event_type, variable_1, variable_2, round(r, 6) AS r, n, CASE WHEN r > 0.8 THEN 'Very Strong' WHEN r > 0.6 THEN 'Strong' ELSE 'Moderate' END AS strength
FROM p WHERE abs(r) > 0.5""")
def e06(spark, sf):
    d = series(spark, sf).withColumn("k2", F.when(F.col("k") <= 60, F.col("k")))
    return missing.missing_correlations(d, ["event_type"], ["v", "k", "k2"])


@query("e07_sensor_failures", f"""
WITH {LONG_SQL}, m AS (SELECT event_type, variable, 100.0 * (count(*) - count(value)) / count(*) AS pct FROM u GROUP BY 1, 2),
g AS (SELECT event_type, variable, max(gap_hours) AS mx, count(*) AS c FROM runs GROUP BY 1, 2)
SELECT event_type, variable, round(pct, 6) AS missing_pct, round(mx, 6) AS max_gap_hours, c AS gap_count,
  CASE WHEN mx > 48 THEN 'Sensor failure' WHEN pct > 30 THEN 'Extensive missing data' WHEN c > 50 THEN 'Communication issues' ELSE 'Normal gaps' END AS failure_type,
  CASE WHEN mx > 48 THEN 'High' WHEN pct > 30 OR c > 50 THEN 'Medium' ELSE 'Low' END AS priority FROM m JOIN g USING (event_type, variable)""")
def e07(spark, sf):
    return missing.sensor_failures(staged(series(spark, sf)), HALF, COLS)


SHUT_SQL = f"""{PLANT_SQL},
n AS (SELECT *, CAST(tm IS NULL AS INT) + CAST(tr IS NULL AS INT) + CAST(tc IS NULL AS INT) + CAST(tout IS NULL AS INT) + CAST(fan IS NULL AS INT) AS c FROM plant),
i AS (SELECT *, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY c >= 2 ORDER BY ts) AS isl FROM n),
s AS (SELECT min(ts) AS start_time, max(ts) AS end_time, arg_min(c, ts) AS columns_missing, isl FROM i WHERE c >= 2 GROUP BY isl
  HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 3600000000)"""


@query("e08_system_shutdowns", f"""
WITH {SHUT_SQL} SELECT start_time, end_time, round((epoch_us(end_time) - epoch_us(start_time)) / 3.6e9, 6) AS duration_hours,
  round((epoch_us(end_time) - epoch_us(start_time)) / 3.6e9 / 24, 6) AS duration_days, CAST(columns_missing AS BIGINT) AS columns_missing, round(20e0 * columns_missing, 6) AS pct_columns FROM s""")
def e08(spark, sf):
    return missing.shutdowns(staged(plant(spark, sf)), PLANT, ALL, 0.4, 1.0)


@query("e08_shutdown_flag", f"""
WITH {SHUT_SQL} SELECT ts, CAST(EXISTS (SELECT 1 FROM s WHERE plant.ts BETWEEN start_time AND end_time) AS INT) AS system_shutdown_flag FROM plant""")
def e08_flag(spark, sf):
    return missing.shutdown_flag(plant(spark, sf), PLANT, ALL, 0.4, 1.0).select("ts", "system_shutdown_flag")


@query("e09_missing_flags", f"""
WITH {HALF_SQL} SELECT event_type, ts, CAST(v IS NULL AS INT) AS v_missing_flag, CAST(k IS NULL AS INT) AS k_missing_flag FROM half""")
def e09(spark, sf):
    return missing.missing_flags(half(spark, sf), COLS).drop("v", "k")


@query("e10_run_summary", f"""
WITH {PLANT_SQL}, s AS (SELECT *, CAST(tm IS NULL AS INT) + CAST(tr IS NULL AS INT) + CAST(tc IS NULL AS INT) AS c FROM plant)
SELECT count(*) AS n_rows, round(100.0 * sum(c) / (3 * count(*)), 6) AS nan_rate, count(*) FILTER (c > 0) AS rows_with_missing,
  count(*) - count(tm) AS tm_missing, count(*) - count(tr) AS tr_missing, count(*) - count(tc) AS tc_missing FROM s""")
def e10(spark, sf):
    return missing.run_summary(plant(spark, sf), [], ["tm", "tr", "tc"])


@query("e11_missing_by_weekday", f"""
WITH {LONG_SQL} SELECT event_type, variable, CAST(isodow(ts) - 1 AS INT) AS weekday, round(100.0 * avg(CAST(value IS NULL AS INT)), 6) AS missing_pct FROM u GROUP BY 1, 2, 3""")
def e11(spark, sf):
    return missing.missing_by_weekday(series(spark, sf), HALF, COLS)


SEASON = "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END"


def seasoned(d):
    return d.withColumn("season", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "first").otherwise("second"))


@query("e12_missing_by_season", f"""
WITH {LONG_SQL} SELECT event_type, {SEASON} AS season, variable, round(100.0 * avg(CAST(value IS NULL AS INT)), 6) AS missing_pct FROM u GROUP BY 1, 2, 3""")
def e12(spark, sf):
    return missing.missing_by_season(seasoned(series(spark, sf)), ["event_type"], "season", COLS)


@query("e12_missing_one_season", f"""
WITH {HALF_SQL}, u AS (SELECT event_type, {SEASON} AS season, 'v' AS variable, v AS value FROM half
  UNION ALL SELECT event_type, {SEASON}, 'late', CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE v END FROM half),
m AS (SELECT event_type, season, variable FROM u WHERE value IS NULL GROUP BY 1, 2, 3)
SELECT event_type, variable, min(season) AS only_season FROM m GROUP BY 1, 2 HAVING count(*) = 1""")
def e12_one(spark, sf):
    d = seasoned(half(spark, sf)).withColumn("late", F.when(F.col("season") == "first", F.lit(1.0)).otherwise(F.col("v")))
    return missing.missing_in_one_season(missing.missing_by_season(d, ["event_type"], "season", ["v", "late"]), ["event_type"], "season")


XGAP_SQL = f"""{LONG_SQL}, x AS (SELECT r.*, lead_ts.ts AS next_valid, (SELECT max(ts) FROM half h WHERE h.event_type = r.event_type AND h.ts < r.start_time) AS row_before,
  (SELECT min(ts) FROM half h WHERE h.event_type = r.event_type AND h.ts > lead_ts.ts) AS row_after FROM runs r
  LEFT JOIN half lead_ts ON lead_ts.event_type = r.event_type AND lead_ts.ts = r.end_time + INTERVAL '30 minutes'),
y AS (SELECT *, coalesce(next_valid, end_time) AS gap_end FROM x),
z AS (SELECT *, (epoch_us(gap_end) - epoch_us(start_time)) / 3.6e9 AS duration_hours FROM y WHERE epoch_us(gap_end) - epoch_us(start_time) > 3600000000)"""


@query("e13_cross_column_gaps", f"""
WITH {XGAP_SQL} SELECT event_type, variable, start_time, gap_end, round(duration_hours, 6) AS duration_hours, row_before, row_after FROM z""")
def e13(spark, sf):
    return missing.cross_column_gaps(staged(series(spark, sf)), HALF, COLS, 3600)


@query("e13_boundary_rows", f"""
WITH {XGAP_SQL}, e AS (SELECT DISTINCT event_type, unnest([row_before, start_time, gap_end, row_after]) AS ts FROM z)
SELECT event_type, half.ts, e.ts IS NOT NULL AS is_boundary FROM half LEFT JOIN e USING (event_type, ts)""")
def e13_rows(spark, sf):
    return missing.boundary_rows(staged(series(spark, sf)), HALF, COLS, 3600).select("event_type", "ts", "is_boundary")


@query("e14_long_null_runs", f"""
WITH {LONG_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY event_type, variable, value IS NULL, isl) AS n FROM i)
SELECT event_type, ts, max(CASE WHEN variable = 'v' THEN value IS NULL AND n >= 3 END) AS v_long_gap,
  max(CASE WHEN variable = 'k' THEN value IS NULL AND n >= 3 END) AS k_long_gap FROM c GROUP BY 1, 2""")
def e14(spark, sf):
    return missing.long_null_runs(series(spark, sf), HALF, COLS, 3).select("event_type", "ts", "v_long_gap", "k_long_gap")


REMOVED_SQL = f"""{HALF_SQL}, r AS (SELECT event_type, ts, 'empty' AS cause, 0 AS i FROM half WHERE v IS NULL UNION ALL SELECT event_type, ts, 'high', 1 FROM half WHERE k > 80
  UNION ALL SELECT event_type, ts, 'peak', 2 FROM half WHERE v > 150),
m AS (SELECT event_type, ts, arg_min(cause, i) AS cause FROM r GROUP BY 1, 2),
j AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) > 2700000000, true) AS brk FROM m),
g AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY event_type ORDER BY ts) AS e FROM j),
eps AS (SELECT event_type, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_rows, arg_min(cause, ts) AS cause,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS duration_hours FROM g GROUP BY event_type, e)"""


def _removed(spark, sf):
    d = staged(half(spark, sf))
    return d, missing.removed_episodes({"empty": d.filter("v IS NULL"), "high": d.filter("k > 80"), "peak": d.filter("v > 150")}, HALF, STEP)


@query("e15_removed_episodes", f"WITH {REMOVED_SQL} SELECT event_type, start_time, end_time, n_rows, cause, round(duration_hours, 6) AS duration_hours FROM eps")
def e15(spark, sf):
    return _removed(spark, sf)[1]


@query("e15_removal_summary", f"""
WITH {REMOVED_SQL}, k AS (SELECT event_type, count(*) AS kept FROM half WHERE v IS NOT NULL AND NOT coalesce(k > 80, false) AND v <= 150 GROUP BY 1),
a AS (SELECT event_type, CAST(sum(n_rows) AS BIGINT) AS removed, count(*) AS n_episodes, max(duration_hours) AS mx, avg(duration_hours) AS mn FROM eps GROUP BY 1)
SELECT event_type, removed, n_episodes, round(mx, 6) AS max_gap_hours, round(mn, 6) AS mean_gap_hours, kept,
  round(100.0 * removed / (removed + kept), 6) AS gap_rate_pct, round(CASE WHEN mn > 0 THEN mx / mn ELSE 1 END, 6) AS clustering_ratio FROM a JOIN k USING (event_type)""")
def e15_summary(spark, sf):
    d, eps = _removed(spark, sf)
    return missing.removal_summary(eps, d.filter("v IS NOT NULL AND NOT coalesce(k > 80, false) AND v <= 150"), HALF)


@query("e16_all_null_episodes", f"""
WITH {PLANT_SQL}, n AS (SELECT ts, tm IS NULL AND tr IS NULL AS c FROM plant), l AS (SELECT *, coalesce(lag(c) OVER (ORDER BY ts), false) AS p FROM n)
SELECT count(*) FILTER (c AND NOT p) AS n_episodes, count(*) FILTER (c) AS n_rows FROM l""")
def e16(spark, sf):
    return missing.all_null_episodes(plant(spark, sf), PLANT, ["tm", "tr"])


_CHECKS = """
u AS (SELECT event_type, 'v' AS variable, v AS value, -5.0 AS a, 400.0 AS b FROM half UNION ALL SELECT event_type, 'k', k, 5.0, 100.0 FROM half),
d AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS d FROM half),
cc AS (SELECT event_type, d, count(*) AS c FROM d WHERE d IS NOT NULL GROUP BY 1, 2), us AS (SELECT event_type, max(c) AS c FROM cc GROUP BY 1),
r AS (SELECT event_type, count(*) AS n, count(*) FILTER (d = 0) AS dup, count(*) FILTER (d > 7200000000) AS gaps FROM d GROUP BY 1),
s AS (SELECT event_type, variable, count(*) AS n, count(value) AS valid, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_samp(value) AS sd,
  count(*) FILTER (value = 0) AS zeros, count(DISTINCT value) AS nd, max(a) AS a, max(b) AS b FROM u GROUP BY 1, 2),
f AS (SELECT event_type, variable, count(*) FILTER (abs(value - mean) > 6 * sd) AS far FROM u JOIN s USING (event_type, variable) GROUP BY 1, 2),
t AS (SELECT * FROM s JOIN f USING (event_type, variable)),
c AS (SELECT event_type, 'duplicate_timestamps' AS "check", '*' AS variable, CAST(dup AS DOUBLE) AS measured, dup = 0 AS passed FROM r
 UNION ALL SELECT event_type, 'time_gaps', '*', gaps, gaps = 0 FROM r
 UNION ALL SELECT event_type, 'irregular_steps_pct', '*', 100.0 * (n - c) / n, 100.0 * (n - c) / n <= 5 FROM r JOIN us USING (event_type)
 UNION ALL SELECT event_type, 'coverage_pct', variable, 100.0 * valid / n, 100.0 * valid / n >= 90 FROM t
 UNION ALL SELECT event_type, 'missing_pct', variable, 100.0 * (n - valid) / n, 100.0 * (n - valid) / n <= 10 FROM t
 UNION ALL SELECT event_type, 'lowest', variable, lo, lo >= a FROM t UNION ALL SELECT event_type, 'highest', variable, hi, hi <= b FROM t
 UNION ALL SELECT event_type, 'constant', variable, nd, nd <> 1 FROM t UNION ALL SELECT event_type, 'near_constant', variable, nd, nd >= 3 FROM t
 UNION ALL SELECT event_type, 'all_zero', variable, zeros, NOT (zeros = valid AND valid > 0) FROM t
 UNION ALL SELECT event_type, 'six_sigma_pct', variable, 100.0 * far / valid, coalesce(100.0 * far / valid <= 1, true) FROM t)
"""


@query("e17_quality_checks", f"""
WITH {HALF_SQL}, {_CHECKS} SELECT event_type, "check", variable, round(measured, 6) AS measured, passed FROM c""")
def e17(spark, sf):
    return missing.quality_checks(staged(half(spark, sf)), HALF, {"v": (-5, 400), "k": (5, 100)})


CLIMATE = {1: 3, 2: 7, 3: 12, 4: 16, 5: 20, 6: 24, 7: 27, 8: 26, 9: 22, 10: 17, 11: 10, 12: 5}


@query("e18_weather_fallback", f"""
WITH {HALF_SQL}, f AS (SELECT event_type, ts, v, k, last_value(v IGNORE NULLS) OVER w AS fv, last_value(k IGNORE NULLS) OVER w AS fk FROM half
  WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
m AS (SELECT event_type, 100.0 * avg(CAST(v IS NULL AS INT)) > 5 AS nv, 100.0 * avg(CAST(k IS NULL AS INT)) > 5 AS nk FROM half GROUP BY 1)
SELECT event_type, ts, CASE WHEN nv THEN coalesce(fv, 3) ELSE v END AS v, CASE WHEN nk THEN coalesce(fk, 60) ELSE k END AS k,
  CAST((nv AND fv IS NULL) OR (nk AND fk IS NULL) AS INT) AS weather_filled FROM f JOIN m USING (event_type)""")
def e18(spark, sf):
    return missing.weather_fallback(half(spark, sf), HALF, "v", "k", CLIMATE, limit=2)


@query("e19_completeness", f"""
WITH {PLANT_SQL} SELECT round((100.0 * count(tm) / count(*) + 100.0 * count(tr) / count(*)) / 2, 6) AS completeness_pct,
  round(100.0 * count(tm) / count(*), 6) AS tm_pct, round(100.0 * count(tr) / count(*), 6) AS tr_pct FROM plant""")
def e19(spark, sf):
    return missing.completeness(plant(spark, sf), [], ["tm", "tr"])


@query("e20_season_fill_share", f"""
WITH {HALF_SQL}, m AS (SELECT event_type, {SEASON} AS season, CAST(v IS NULL AS INT) AS a, CAST(k IS NULL OR k > 50 AS INT) AS b FROM half),
p AS (SELECT event_type, 'v' AS variable, 100.0 * avg(a) FILTER (season = 'first') AS pa, 100.0 * avg(a) FILTER (season = 'second') AS pb FROM m GROUP BY 1
 UNION ALL SELECT event_type, 'k', 100.0 * avg(b) FILTER (season = 'first'), 100.0 * avg(b) FILTER (season = 'second') FROM m GROUP BY 1)
SELECT event_type, variable, round(pa, 6) AS pct_a, round(pb, 6) AS pct_b, coalesce(abs(pa - pb) > 1, false) AS unequal FROM p""")
def e20(spark, sf):
    d = seasoned(half(spark, sf)).withColumns({"v_is_interpolated": F.isnull("v"), "k_is_interpolated": F.isnull("k") | (F.col("k") > 50)})
    return missing.season_fill_share(d, ["event_type"], "season", {"v": "v_is_interpolated", "k": "k_is_interpolated"}, "first", "second", 1.0)


# known neighbours of every row, then the linear fill
INTERP_SQL = f"""{HALF_SQL}, kn AS (SELECT event_type, ts, v, k, max(CASE WHEN v IS NOT NULL THEN ts END) OVER p AS ta, min(CASE WHEN v IS NOT NULL THEN ts END) OVER f AS tz,
  last_value(v IGNORE NULLS) OVER p AS va, first_value(v IGNORE NULLS) OVER f AS vz FROM half
  WINDOW p AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT event_type, ts, v AS raw, CASE WHEN v IS NOT NULL THEN v
  WHEN coalesce((epoch_us(ts) - epoch_us(ta)) // 1800000000 <= {{n}}, false) OR coalesce((epoch_us(tz) - epoch_us(ts)) // 1800000000 <= {{n}}, false) THEN
    CASE WHEN ta IS NULL THEN vz WHEN tz IS NULL THEN va ELSE va + (vz - va) * (epoch_us(ts) - epoch_us(ta)) / (epoch_us(tz) - epoch_us(ta)) END END AS v FROM kn)"""


@query("f01_time_interpolation", f"WITH {INTERP_SQL.format(n=1)} SELECT event_type, ts, round(v, 8) AS v FROM filled", digits=8)
def f01(spark, sf):
    return impute.interpolate_time(half(spark, sf).select("event_type", "ts", "v"), HALF, ["v"], 1)


@query("f02_step_fill", f"""
WITH {HALF_SQL}, a AS (SELECT event_type, ts, last_value(k IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS k FROM half)
SELECT event_type, ts, first_value(k IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS k FROM a""")
def f02(spark, sf):
    return impute.fill_steps(half(spark, sf).select("event_type", "ts", "k"), HALF, ["k"], 1)


def restore_sql(n, base=HALF_SQL):
    """Linear fill with runs of at least ``n`` missing rows left missing."""
    return INTERP_SQL.format(n=n).replace(HALF_SQL, base) + f""", il AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - row_number() OVER (PARTITION BY event_type, raw IS NULL ORDER BY ts) AS isl FROM filled),
cn AS (SELECT *, count(*) OVER (PARTITION BY event_type, raw IS NULL, isl) AS n FROM il),
fin AS (SELECT event_type, ts, raw, CASE WHEN raw IS NULL AND n >= {n} THEN NULL ELSE v END AS v, start_time FROM cn
  LEFT JOIN (SELECT event_type AS e2, raw IS NULL AS r2, isl AS i2, min(ts) AS start_time FROM il GROUP BY 1, 2, 3) ON e2 = event_type AND i2 = isl AND r2 = (raw IS NULL))"""


RESTORE_SQL = restore_sql(2)


@query("f03_restore_long_gaps", f"WITH {RESTORE_SQL} SELECT event_type, ts, round(v, 8) AS v FROM fin", digits=8)
def f03(spark, sf):
    d = missing.long_null_runs(staged(half(spark, sf)).select("event_type", "ts", "v"), HALF, ["v"], 2)
    return impute.restore_long_gaps(impute.interpolate_time(d, HALF, ["v"], 2), ["v"]).select("event_type", "ts", "v")


@query("f04_drop_incomplete", f"WITH {HALF_SQL} SELECT event_type, ts, v, k FROM half WHERE v IS NOT NULL AND k IS NOT NULL")
def f04(spark, sf):
    return impute.drop_incomplete(half(spark, sf), COLS)


@query("f05_fill_masks", f"WITH {RESTORE_SQL} SELECT event_type, ts, round(v, 8) AS temp, raw IS NULL AND v IS NOT NULL AS temp_is_interpolated FROM fin", digits=8)
def f05(spark, sf):
    d = staged(half(spark, sf)).select("event_type", "ts", F.col("v").alias("temp"))
    return impute.gap_safe_fill(d, HALF, ["temp"], max_gap_hours=1.0)


@query("f06_fill_summary", f"""
WITH {RESTORE_SQL}, ks AS (SELECT event_type, ts, k, row_number() OVER (PARTITION BY event_type ORDER BY ts) - row_number() OVER (PARTITION BY event_type, k IS NULL ORDER BY ts) AS isl FROM half),
kc AS (SELECT *, count(*) OVER (PARTITION BY event_type, k IS NULL, isl) AS n FROM ks)
SELECT event_type, 'temp' AS variable, count(*) FILTER (raw IS NULL AND v IS NOT NULL) AS points_filled, 'linear_time' AS method, 2 AS limit_rows FROM fin GROUP BY 1
UNION ALL SELECT event_type, 'fan', count(*) FILTER (k IS NULL AND n < 2), 'forward_fill', 2 FROM kc GROUP BY 1""")
def f06(spark, sf):
    d = staged(half(spark, sf)).withColumnsRenamed({"v": "temp", "k": "fan"})
    d = impute.gap_safe_fill(d, HALF, ["temp", "fan"], max_gap_hours=1.0)
    return impute.fill_summary(d, ["event_type"], ["temp", "fan"], 2)


@query("f07_median_imputation", f"""
WITH {HALF_SQL}, m AS (SELECT event_type, quantile_cont(v, 0.5) AS q FROM half GROUP BY 1)
SELECT event_type, ts, round(coalesce(v, q), 6) AS v FROM half JOIN m USING (event_type)""")
def f07(spark, sf):
    return impute.median_impute(half(spark, sf).select("event_type", "ts", "v"), ["event_type"], ["v"])


@query("flagship_gap_safe_fill", f"""
WITH {RESTORE_SQL} SELECT event_type, ts, round(v, 8) AS temp, raw IS NULL AND v IS NOT NULL AS temp_is_interpolated,
  CASE WHEN raw IS NULL THEN start_time END AS gap_start FROM fin""", digits=8)
def flagship(spark, sf):
    """Resample, grid, long-gap detection, interpolation, masks and the gap each filled row belongs to."""
    from tidegrid.plans.blocks import run_starts

    d = staged(half(spark, sf)).select("event_type", "ts", F.col("v").alias("temp"))
    runs = run_starts(d, HALF, F.col("temp").isNull(), "gap_start").select("event_type", "ts", "gap_start")
    return impute.gap_safe_fill(d, HALF, ["temp"], max_gap_hours=1.0).join(runs, ["event_type", "ts"], "left")


RAW_HALF_SQL = f"""{EVENTS_SQL}, rw AS (SELECT event_type, date_trunc('second', ts) AS ts, event_id, CAST(round(CAST(value AS DECIMAL(18,2)), 1) AS DOUBLE) AS t, k FROM ev),
fp AS (SELECT event_type, ts, arg_min_null(CASE WHEN t BETWEEN -10 AND 60 THEN t END, event_id) AS temp, arg_min(k, event_id) AS fan FROM rw GROUP BY 1, 2),
hb AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS ts, avg(temp) AS v, avg(fan) AS k FROM fp GROUP BY 1, 2),
hg AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM hb GROUP BY 1),
half AS (SELECT hg.event_type, hg.ts, hb.v, hb.k FROM hg LEFT JOIN hb ON hg.event_type = hb.event_type AND hg.ts = hb.ts)"""


@query("flagship_raw_to_clean", f"""
WITH {restore_sql(8, RAW_HALF_SQL)}, ks AS (SELECT event_type, ts, k, row_number() OVER w - row_number() OVER (PARTITION BY event_type, k IS NULL ORDER BY ts) AS isl,
  coalesce(last_value(k IGNORE NULLS) OVER w, first_value(k IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS kf FROM half WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
kc AS (SELECT *, k IS NULL AND count(*) OVER (PARTITION BY event_type, k IS NULL, isl) < 8 AS filled FROM ks)
SELECT event_type, ts, round(v, 6) AS temp, round(CASE WHEN k IS NOT NULL OR kc.filled THEN kf END, 6) AS fan, raw IS NULL AND v IS NOT NULL AS temp_is_interpolated, kc.filled AS fan_is_interpolated FROM fin JOIN kc USING (event_type, ts)""")
def raw_to_clean(spark, sf):
    """Raw export lines to the cleaned, gridded and filled series in one chain with one stage table."""
    from tidegrid.operators import grid
    from tidegrid.queries.ingest import a02

    d = a02(spark, sf).withColumnRenamed("file", "event_type")
    d = clean.coarse_limits(d, ["temp"], -10, 60)
    d = clean.first_per_timestamp(d.select("event_type", "ts", "event_id", "temp", "fan"), HALF)
    d = staged(grid.resample_mean(d, HALF, STEP, ["temp", "fan"]))
    return impute.gap_safe_fill(d, HALF, ["temp", "fan"])
