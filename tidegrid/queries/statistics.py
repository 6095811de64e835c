"""Queries for statistics, profiles and setpoint tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import grid, outlier, profiles, stats
from tidegrid.plans.series import Series
from tidegrid.queries import sqltails
from tidegrid.queries.gaps import SEASON, seasoned
from tidegrid.queries.inputs import HALF, HALF_SQL, PLANT_SQL, half, plant, table, staged
from tidegrid.queries.outliers import LONG
from tidegrid.queries.registry import query

KEY = ["event_type"]
COLS = ["v", "k"]
MOMENTS = """m AS (SELECT event_type, variable, avg(value) AS mu, count(value) AS n FROM u GROUP BY 1, 2),
c AS (SELECT event_type, variable, max(n) AS n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM u JOIN m USING (event_type, variable) GROUP BY 1, 2),
sk AS (SELECT event_type, variable, n, m3 / (m2 * sqrt(m2)) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM c)"""
DESC = f"""{LONG}, {MOMENTS}, ds AS (SELECT event_type, variable, count(value) AS count, 100.0 * count(value) / count(*) AS valid_pct, avg(value) AS mean, stddev_samp(value) AS std, var_samp(value) AS variance,
 min(value) AS min, max(value) AS max, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.95) AS p95 FROM u GROUP BY 1, 2),
st AS (SELECT ds.*, skewness, kurtosis, 100.0 * std / mean AS cv_pct, max - min AS range, q3 - q1 AS iqr FROM ds JOIN sk USING (event_type, variable))"""
R = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)


@query("i01_describe", f"""WITH {DESC} SELECT event_type, variable, count, {R('valid_pct', 'mean', 'std', 'variance', 'min', 'max', 'p5', 'q1', 'median', 'q3', 'p95', 'cv_pct', 'range', 'iqr')} FROM st""")
def i01(spark, sf):
    return stats.describe(staged(half(spark, sf)), KEY, COLS).drop("skewness", "kurtosis")


@query("i02_skew_kurtosis", f"WITH {DESC} SELECT event_type, variable, {R('skewness', 'kurtosis')} FROM st")
def i02(spark, sf):
    return stats.describe(staged(half(spark, sf)), KEY, COLS).select("event_type", "variable", "skewness", "kurtosis")


@query("i03_jarque_bera", f"""
WITH {DESC}, j AS (SELECT *, count / 6 * (skewness ** 2 + kurtosis ** 2 / 4) AS jb FROM st)
SELECT event_type, variable, round(jb, 4) AS jb_stat, round(exp(-jb / 2), 4) AS jb_p, exp(-jb / 2) > 0.05 AS jb_normal FROM j""", digits=4)
def i03(spark, sf):
    return stats.jarque_bera(stats.describe(staged(half(spark, sf)), KEY, COLS)).select("event_type", "variable", "jb_stat", "jb_p", "jb_normal")


_Z = "((value - mean) / sd)"
AD = f"""{LONG}, am AS (SELECT event_type, variable, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM u GROUP BY 1, 2),
az AS (SELECT event_type, variable, n, row_number() OVER (PARTITION BY event_type, variable ORDER BY value) AS i, {_Z} AS z FROM u JOIN am USING (event_type, variable) WHERE value IS NOT NULL),
ad AS (SELECT event_type, variable, max(n) AS n, -max(n) - sum((2 * i - 1) * ln({sqltails.normal_cdf('z')}) + (2 * (n - i) + 1) * ln({sqltails.normal_cdf('(-z)')})) / max(n) AS ad_stat FROM az GROUP BY 1, 2),
ac AS (SELECT *, round(0.787 / (1 + 4 / n - 25 / n / n), 3) AS ad_critical FROM ad)"""


@query("i04_anderson_darling", f"WITH {AD} SELECT event_type, variable, n, round(ad_stat, 5) AS ad_stat, ad_critical, ad_stat < ad_critical AS ad_normal FROM ac", digits=5)
def i04(spark, sf):
    return stats.anderson_darling(staged(half(spark, sf)), KEY, COLS)


@query("i05_interpretation", f"""
WITH {DESC},
o AS (SELECT u.event_type, u.variable, 100.0 * count(*) FILTER (value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr) / count(value) AS p FROM u JOIN st USING (event_type, variable) GROUP BY 1, 2)
SELECT event_type, variable, CASE WHEN cv_pct < 5 THEN 'very stable' WHEN cv_pct < 15 THEN 'moderate variability' ELSE 'high variability' END AS cv_label,
 'Non-Normal' AS distribution, CASE WHEN p < 1 THEN 'Low' WHEN p < 5 THEN 'Moderate' ELSE 'High' END AS outlier_severity FROM st JOIN o USING (event_type, variable)""")
def i05(spark, sf):
    d = staged(half(spark, sf))
    by = ["event_type", "variable"]
    s = stats.jarque_bera(stats.describe(d, KEY, COLS))
    s = s.join(stats.anderson_darling(d, KEY, COLS).select(*by, "ad_normal"), by)
    s = s.join(outlier.statistical_counts(d, KEY, COLS).select(*by, "iqr_pct"), by)
    return stats.interpret(s).select(*by, "cv_label", "distribution", "outlier_severity")


@query("i06_histogram", f"""
WITH {LONG}, e AS (SELECT event_type, variable, min(value) AS lo, max(value) AS hi FROM u GROUP BY 1, 2)
SELECT event_type, variable, CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, round(lo + least(floor((value - lo) / ((hi - lo) / 50)), 49) * ((hi - lo) / 50), 6) AS bin_from,
 round(lo + (least(floor((value - lo) / ((hi - lo) / 50)), 49) + 1) * ((hi - lo) / 50), 6) AS bin_to, count(*) AS count FROM u JOIN e USING (event_type, variable) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
def i06(spark, sf):
    return stats.histogram(half(spark, sf), KEY, COLS)


@query("i06_kernel_density", f"""
WITH {LONG}, e AS (SELECT event_type, variable, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, count(value) AS n FROM u GROUP BY 1, 2),
p AS (SELECT *, unnest(range(0, 200)) AS point, sd * pow(n, -0.2) AS h FROM e), x AS (SELECT *, lo + point * ((hi - lo) / 199) AS x FROM p)
SELECT event_type, variable, CAST(point AS INT) AS point, round(max(x), 6) AS x, round(sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h)) / (n * h * sqrt(2 * pi()))), 6) AS density,
 round(sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h)) / (n * h * sqrt(2 * pi()))) * max(n) * max((hi - lo)) / 50, 6) AS scaled FROM x JOIN u USING (event_type, variable) WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def i06_kde(spark, sf):
    return stats.kde(half(spark, sf), KEY, COLS)


_PM = """p AS (SELECT 'tm_tr' AS pair, tm AS x, tr AS y, 20.0 AS lim FROM plant UNION ALL SELECT 'tout_tm', tout, tm, 20.0 FROM plant UNION ALL SELECT 'fan_dt', fan, tr - tm, 30.0 FROM plant),
pm AS (SELECT pair, count(y - x) AS n, corr(x, y) AS r, avg(y - x) AS mean_diff, stddev_samp(y - x) AS std_diff, sqrt(avg((y - x) ** 2)) AS rmse, avg(abs(y - x)) AS mae, max(abs(y - x)) AS max_abs,
 100.0 * count(*) FILTER (abs(y - x) <= lim) / count(y - x) AS within_pct FROM p GROUP BY 1)"""


def _pairs(spark, sf):
    return stats.pair_metrics(plant(spark, sf), [], {"tm_tr": ("tm", "tr", 20.0), "tout_tm": ("tout", "tm", 20.0), "fan_dt": ("fan", F.col("tr") - F.col("tm"), 30.0)})


@query("i07_pair_metrics", f"WITH {PLANT_SQL}, {_PM} SELECT pair, n, {R('r', 'mean_diff', 'std_diff', 'rmse', 'mae', 'max_abs', 'within_pct')} FROM pm")
def i07(spark, sf):
    return _pairs(spark, sf)


@query("i08_density_grid", """
WITH d AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem), e AS (SELECT l_returnflag, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS c FROM d GROUP BY 1)
SELECT d.l_returnflag, CAST(least(floor((x - x0) / ((x1 - x0) / 50)), 49) AS BIGINT) AS x_bin, CAST(least(floor((y - y0) / ((y1 - y0) / 50)), 49) AS BIGINT) AS y_bin, count(*) AS count
FROM d JOIN e USING (l_returnflag) GROUP BY 1, 2, 3""")
def i08(spark, sf):
    return stats.density_grid(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("i09_pair_assessment", f"""
WITH {PLANT_SQL}, {_PM} SELECT pair, CASE WHEN within_pct > 85 THEN 'excellent' WHEN within_pct > 70 THEN 'good' WHEN within_pct > 50 THEN 'moderate issues' ELSE 'control problems' END AS tracking,
 CASE WHEN r > 0.85 THEN 'strong' WHEN r > 0.6 THEN 'moderate' ELSE 'weak' END AS relationship, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS influence,
 CASE WHEN abs(r) > 0.5 THEN 'clear' ELSE 'weak' END AS effort, CASE WHEN r < -0.3 THEN 'inverse as expected' WHEN r > 0.3 THEN 'unexpected positive' ELSE 'weak' END AS inverse_check FROM pm""")
def i09(spark, sf):
    return stats.assess_pairs(_pairs(spark, sf)).select("pair", "tracking", "relationship", "influence", "effort", "inverse_check")


CLOCK = f"{LONG}, w AS (SELECT event_type, variable, ts, value, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour FROM u)"


@query("i10_weekly_aggregates", f"""
WITH {CLOCK} SELECT event_type, variable, weekday, hour, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS count, round(quantile_cont(value, 0.5), 6) AS median FROM w GROUP BY 1, 2, 3, 4""")
def i10(spark, sf):
    return profiles.weekly_aggregates(staged(half(spark, sf)), HALF, COLS)


@query("i11_week_features", """
SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS INT) AS iso_week, isoyear(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS year_week, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start FROM orders""")
def i11(spark, sf):
    return profiles.week_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


STACK = f"{HALF_SQL}, s AS (SELECT event_type, isoyear(ts) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS year_week, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, avg(v) AS mean FROM half GROUP BY 1, 2, 3, 4)"


@query("i12_stacked_weeks", f"WITH {STACK} SELECT event_type, year_week, weekday, hour, round(mean, 8) AS mean FROM s", digits=8)
def i12(spark, sf):
    return profiles.stacked_weeks(half(spark, sf), HALF, "v")


@query("i12_stacked_weeks_wide", f"WITH {STACK} SELECT event_type, year_week, hour, " + ", ".join(f"round(max(CASE WHEN weekday = {d} THEN mean END), 8) AS d{d}" for d in range(7)) + " FROM s GROUP BY 1, 2, 3", digits=8)
def i12_wide(spark, sf):
    return profiles.stacked_weeks_wide(profiles.stacked_weeks(half(spark, sf), HALF, "v"), KEY)


@query("i13_weekend_curve", f"WITH {CLOCK} SELECT event_type, variable, hour, weekday >= 5 AS is_weekend, round(avg(value), 8) AS mean FROM w GROUP BY 1, 2, 3, 4", digits=8)
def i13(spark, sf):
    return profiles.weekend_curve(half(spark, sf), HALF, COLS)


ORDERS = Series(("o_orderpriority",), "o_orderdate")


@query("i14_monthly_curves", """
WITH d AS (SELECT o_orderpriority, CAST(month(o_orderdate) AS INT) AS month, CAST(year(o_orderdate) AS INT) AS year, CAST(hour(o_orderdate) AS INT) AS hour, o_totalprice AS v FROM orders),
y AS (SELECT o_orderpriority, month, arg_max(year, struct_pack(c := c, y := -year)) AS year FROM (SELECT o_orderpriority, month, year, count(*) AS c FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT o_orderpriority, month, hour, round(mean, 4) AS mean, year, 'winter' AS season, CAST(coalesce(list_position([10, 11, 12, 1, 2, 3, 4], month), 0) AS BIGINT) AS month_order
FROM (SELECT o_orderpriority, month, hour, avg(v) AS mean FROM d GROUP BY 1, 2, 3) JOIN y USING (o_orderpriority, month)""", digits=4)
def i14(spark, sf):
    return profiles.monthly_curves(table(spark, sf, "orders"), ORDERS, "o_totalprice")


@query("i15_weekly_kpis", f"""
WITH {CLOCK}, h AS (SELECT event_type, variable, hour, avg(value) FILTER (weekday < 5) AS wd, avg(value) FILTER (weekday >= 5) AS we FROM w GROUP BY 1, 2, 3),
c AS (SELECT event_type, variable, weekday, hour, count(value) AS n FROM w GROUP BY 1, 2, 3, 4), l AS (SELECT event_type, variable, 100.0 * count(*) FILTER (n < 5) / 168 AS low FROM c GROUP BY 1, 2)
SELECT event_type, variable, arg_max(hour, wd) AS peak_hour, round(max(wd) / CASE WHEN min(wd) > 0 THEN min(wd) END, 6) AS peak_valley_ratio, round(avg(wd - we), 6) AS weekday_weekend_delta, round(max(low), 6) AS low_count_pct
FROM h JOIN l USING (event_type, variable) GROUP BY 1, 2""")
def i15(spark, sf):
    return profiles.weekly_kpis(staged(half(spark, sf)), HALF, COLS)


@query("i16_daily_bands", f"""
WITH {CLOCK}, d AS (SELECT event_type, variable, weekday, hour, CAST(ts AS DATE) AS date, avg(value) AS m FROM w GROUP BY 1, 2, 3, 4, 5)
SELECT event_type, variable, weekday, hour, round(min(m), 8) AS low, round(avg(m), 8) AS mean, round(max(m), 8) AS high FROM d GROUP BY 1, 2, 3, 4""", digits=8)
def i16(spark, sf):
    return profiles.daily_bands(half(spark, sf), HALF, COLS)


@query("i17_season_profiles", f"""
WITH {CLOCK}, s AS (SELECT *, {SEASON} AS season FROM w)
SELECT event_type, season, variable, hour, weekday, round(avg(value), 6) AS mean FROM s GROUP BY GROUPING SETS ((event_type, season, variable, hour), (event_type, season, variable, hour, weekday))""")
def i17(spark, sf):
    return profiles.season_profiles(seasoned(half(spark, sf)), HALF, "season", COLS)


@query("i18_load_duration", f"""
WITH {HALF_SQL}, r AS (SELECT event_type, v AS value, row_number() OVER (PARTITION BY event_type ORDER BY v DESC) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM half WHERE v IS NOT NULL)
SELECT event_type, value, count(*) AS n, round(min(100.0 * (i - 1) / (c - 1)), 6) AS pct_from, round(max(100.0 * (i - 1) / (c - 1)), 6) AS pct_to FROM r GROUP BY 1, 2""")
def i18(spark, sf):
    return stats.load_duration(staged(half(spark, sf)), KEY, "v")


@query("i19_season_statistics", f"""
WITH {LONG}, s AS (SELECT *, {SEASON} AS season FROM u) SELECT event_type, season, variable, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
 min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(100.0 * stddev_samp(value) / avg(value), 6) AS cv_pct FROM s GROUP BY 1, 2, 3""")
def i19(spark, sf):
    return stats.season_stats(seasoned(staged(half(spark, sf))), KEY, "season", COLS)


DAILY = f"""{LONG}, dy AS (SELECT event_type, variable, {SEASON} AS season, CAST(ts AS DATE) AS date, avg(value) AS x FROM u GROUP BY 1, 2, 3, 4 HAVING count(value) > 0),
a AS (SELECT event_type, variable, count(*) FILTER (season = 'first') AS na, count(*) FILTER (season = 'second') AS nb, avg(x) FILTER (season = 'first') AS ma, avg(x) FILTER (season = 'second') AS mb,
 var_samp(x) FILTER (season = 'first') AS va, var_samp(x) FILTER (season = 'second') AS vb FROM dy GROUP BY 1, 2)"""


def _tests(spark, sf):
    d = seasoned(staged(half(spark, sf)))
    d = grid.daily_mean(d, Series(("event_type", "season"), "ts"), COLS)
    return stats.compare_groups(d, KEY, "season", "first", "second", COLS)


_T, _DF = "((ma - mb) / sqrt(va / na + vb / nb))", "((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)))"


@query("i20_welch_t_test", f"""
WITH {DAILY}, t AS (SELECT *, {_T} AS t, {_DF} AS df FROM a), p AS (SELECT *, {sqltails.t_two_sided('t', 'df')} AS p FROM t)
SELECT event_type, variable, na AS n_a, nb AS n_b, round(t, 6) AS t_stat, round(p, 6) AS t_p, p < 0.05 AS t_significant FROM p""")
def i20(spark, sf):
    return _tests(spark, sf).select("event_type", "variable", "n_a", "n_b", "t_stat", "t_p", "t_significant")


_UZ = "((greatest(u, na * nb - u) - na * nb / 2.0 - 0.5) / sqrt(na * nb / 12.0 * (na + nb + 1)))"


@query("i21_mann_whitney", f"""
WITH {DAILY}, r AS (SELECT *, rank() OVER (PARTITION BY event_type, variable ORDER BY x) + (count(*) OVER (PARTITION BY event_type, variable, x) - 1) / 2.0 AS rk FROM dy),
us AS (SELECT event_type, variable, sum(rk) FILTER (season = 'first') - max(na) * (max(na) + 1) / 2.0 AS u, max(na) AS na, max(nb) AS nb FROM r JOIN a USING (event_type, variable) GROUP BY 1, 2),
z AS (SELECT *, {_UZ} AS z FROM us), p AS (SELECT *, least(1.0, 2 * {sqltails.normal_cdf('(-z)')}) AS p FROM z)
SELECT event_type, variable, u AS u_stat, round(p, 6) AS u_p, p < 0.05 AS u_significant FROM p""")
def i21(spark, sf):
    return _tests(spark, sf).select("event_type", "variable", "u_stat", "u_p", "u_significant")


@query("i22_kolmogorov_smirnov", f"""
WITH {DAILY}, r AS (SELECT event_type, variable, count(*) FILTER (season = 'first') OVER w / max(na) OVER v AS fa, count(*) FILTER (season = 'second') OVER w / max(nb) OVER v AS fb, na, nb
 FROM dy JOIN a USING (event_type, variable) WINDOW w AS (PARTITION BY event_type, variable ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY event_type, variable)),
k AS (SELECT event_type, variable, max(abs(fa - fb)) AS d, sqrt(max(na) * max(nb) / (max(na) + max(nb))) * max(abs(fa - fb)) AS x FROM r GROUP BY 1, 2), p AS (SELECT *, {sqltails.kolmogorov('x')} AS p FROM k)
SELECT event_type, variable, round(d, 6) AS ks_stat, round(p, 6) AS ks_p, p < 0.05 AS ks_significant FROM p""")
def i22(spark, sf):
    return _tests(spark, sf).select("event_type", "variable", "ks_stat", "ks_p", "ks_significant")


@query("i23_cohens_d", f"""
WITH {DAILY}, c AS (SELECT *, (ma - mb) / sqrt((va + vb) / 2) AS d FROM a)
SELECT event_type, variable, round(ma - mb, 6) AS mean_diff, round(d, 6) AS cohens_d, CASE WHEN abs(d) < 0.2 THEN 'Negligible' WHEN abs(d) < 0.5 THEN 'Small' WHEN abs(d) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect_size FROM c""")
def i23(spark, sf):
    return _tests(spark, sf).select("event_type", "variable", "mean_diff", "cohens_d", "effect_size")


@query("i24_kpi_board", f"""
WITH {LONG}, s AS (SELECT *, {SEASON} AS season FROM u) SELECT event_type, season, variable, round(avg(value), 6) AS mean, round(100.0 * stddev_samp(value) / avg(value), 6) AS cv_pct, round(max(value) - min(value), 6) AS range,
 count(*) FILTER (value > 0.1) / 2.0 AS operating_hours FROM s GROUP BY 1, 2, 3""")
def i24(spark, sf):
    return stats.kpi_board(seasoned(half(spark, sf)), KEY, "season", COLS)


@query("i24_significant_share", f"""
WITH {DAILY}, t AS (SELECT *, {_T} AS t, {_DF} AS df FROM a), p AS (SELECT *, {sqltails.t_two_sided('t', 'df')} AS p FROM t)
SELECT event_type, count(*) FILTER (p < 0.05) AS n_significant, count(*) AS n_tests, round(100.0 * avg(CAST(p < 0.05 AS INT)), 6) AS significant_pct FROM p GROUP BY 1""")
def i24_share(spark, sf):
    return stats.significant_share(_tests(spark, sf), KEY)


@query("i25_humidity_daily_trend", f"WITH {HALF_SQL} SELECT event_type, {SEASON} AS season, CAST(ts AS DATE) AS date, round(avg(k), 8) AS k FROM half GROUP BY 1, 2, 3", digits=8)
def i25(spark, sf):
    return grid.daily_mean(seasoned(half(spark, sf)), Series(("event_type", "season"), "ts"), ["k"])


KPI = "round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(stddev_pop(e), 6) AS std_dev, round(100.0 * avg(CAST(coalesce(abs(e) <= 10, false) AS INT)), 6) AS time_in_band_pct, round(100.0 * avg(CAST(coalesce(e > 10, false) AS INT)), 6) AS overshoot_pct, round(100.0 * avg(CAST(coalesce(e < -10, false) AS INT)), 6) AS undershoot_pct, count(e) AS count"


@query("i26_setpoint_kpis", f"WITH {HALF_SQL}, e AS (SELECT event_type, v - k AS e FROM half) SELECT event_type, {KPI} FROM e GROUP BY 1")
def i26(spark, sf):
    return profiles.setpoint_kpis(half(spark, sf), KEY, "v", "k", 10.0)


@query("i27_pair_kpis", f"""
WITH {HALF_SQL}, f AS (SELECT event_type, ts, v, last_value(k IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM half),
s AS (SELECT event_type, avg(v) OVER w AS v, avg(k) OVER w AS k FROM f WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), e AS (SELECT event_type, v - k AS e FROM s)
SELECT event_type, {KPI} FROM e GROUP BY 1""")
def i27(spark, sf):
    sp = profiles.season_pair("winter", "cooling_sp", "k", ["v", "k"])
    return profiles.pair_kpis(staged(half(spark, sf)), HALF, "v", sp, 4, 10.0)


@query("i28_operation_view", f"""
WITH {HALF_SQL} SELECT event_type, ts, v, k FROM half WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""")
def i28(spark, sf):
    d = half(spark, sf).withColumn("k", F.col("k") / 100)
    return profiles.operation_view(d, HALF, ["v"], ["k"], "2024-01-05", "2024-01-12")


