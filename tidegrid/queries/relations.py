"""Queries for correlation, lag analysis and feature relevance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidegrid.operators import correlate, importance
from tidegrid.queries import sqltails
from tidegrid.queries.inputs import HALF, HALF_SQL, PLANT_SQL, SIGNALS, half, plant, staged
from tidegrid.queries.registry import query

ALL = list(SIGNALS)
PAIRS = list(combinations(ALL, 2))
_each = lambda fmt, pairs=PAIRS: " UNION ALL ".join(fmt.format(a=a, b=b) for a, b in pairs)
PEARSON = f"{PLANT_SQL}, pr AS (" + _each("SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM plant") + ")"
_T = "(r * sqrt((n - 2) / (1 - r * r)))"
PV = f"{PEARSON}, pv AS (SELECT *, {sqltails.t_two_sided(_T, '(n - 2)')} AS p FROM pr)"


def _xy(pairs):
    return "xy AS (" + _each("SELECT '{a}' AS variable_1, '{b}' AS variable_2, {a} AS x, {b} AS y FROM plant WHERE {a} IS NOT NULL AND {b} IS NOT NULL", pairs) + ")"


_RANK = """rk AS (SELECT variable_1, variable_2, rank() OVER (PARTITION BY variable_1, variable_2 ORDER BY x) + (count(*) OVER (PARTITION BY variable_1, variable_2, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY variable_1, variable_2 ORDER BY y) + (count(*) OVER (PARTITION BY variable_1, variable_2, y) - 1) / 2.0 AS ry FROM xy),
sp AS (SELECT variable_1, variable_2, corr(rx, ry) AS r, count(*) AS n FROM rk GROUP BY 1, 2)"""


def pearson(spark, sf):
    return correlate.pearson_pairs(plant(spark, sf), [], ALL)


@query("j01_pearson", f"WITH {PEARSON} SELECT variable_1, variable_2, round(r, 8) AS r, n FROM pr", digits=8)
def j01(spark, sf):
    return pearson(spark, sf)


@query("j01_matrix", f"""
WITH {PEARSON} SELECT variable_1, variable_2, round(r, 8) AS r FROM pr UNION ALL SELECT variable_2, variable_1, round(r, 8) FROM pr
UNION ALL SELECT DISTINCT v, v, 1.0 FROM (SELECT variable_1 AS v FROM pr UNION SELECT variable_2 FROM pr)""", digits=8)
def j01_matrix(spark, sf):
    return correlate.matrix(pearson(spark, sf), [])


@query("j02_spearman", f"WITH {PLANT_SQL}, {_xy(PAIRS)}, {_RANK} SELECT variable_1, variable_2, round(r, 8) AS r, n FROM sp", digits=8)
def j02(spark, sf):
    return correlate.spearman_pairs(staged(plant(spark, sf)), [], ALL)


@query("j03_kendall", f"""
WITH {PLANT_SQL}, {_xy(PAIRS)}, i AS (SELECT *, row_number() OVER (PARTITION BY variable_1, variable_2 ORDER BY x, y) AS id FROM xy),
s AS (SELECT a.variable_1, a.variable_2, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (a.x <> b.x) AS tx, count(*) FILTER (a.y <> b.y) AS ty
 FROM i a JOIN i b ON a.variable_1 = b.variable_1 AND a.variable_2 = b.variable_2 AND a.id < b.id GROUP BY 1, 2), n AS (SELECT variable_1, variable_2, count(*) AS n FROM xy GROUP BY 1, 2)
SELECT variable_1, variable_2, round(s / (sqrt(tx) * sqrt(ty)), 8) AS r, n FROM s JOIN n USING (variable_1, variable_2)""", digits=8)
def j03(spark, sf):
    return correlate.kendall_pairs(staged(plant(spark, sf)), [], ALL)


@query("j04_p_values", f"WITH {PV} SELECT variable_1, variable_2, round(r, 6) AS r, n, round(p, 6) AS p_value FROM pv")
def j04(spark, sf):
    return correlate.p_values(pearson(spark, sf))


@query("j05_false_discovery", f"""
WITH {PV}, o AS (SELECT *, row_number() OVER (ORDER BY p, variable_1, variable_2) AS i, count(*) OVER () AS m FROM pv),
a AS (SELECT *, least(1.0, min(p * m / i) OVER (ORDER BY i DESC)) AS q FROM o)
SELECT variable_1, variable_2, round(r, 6) AS r, n, round(p, 6) AS p_value, round(q, 6) AS p_adjusted, q <= 0.05 AS is_significant FROM a""")
def j05(spark, sf):
    return correlate.fdr(correlate.p_values(pearson(spark, sf)), [])


@query("j06_column_hygiene", f"""
WITH {PLANT_SQL}, c AS (SELECT *, 5.0 AS const FROM plant), u AS (SELECT * FROM c UNPIVOT INCLUDE NULLS (x FOR variable IN (tm, tr, tc, tout, fan, const)))
SELECT variable, round(count(x) / count(*), 6) AS coverage, round(var_samp(x), 6) AS variance, count(x) / count(*) >= 0.7 AND var_samp(x) > 0 AS keep FROM u GROUP BY 1""")
def j06(spark, sf):
    return correlate.hygiene(plant(spark, sf).withColumn("const", F.lit(5.0)), [*ALL, "const"])


# names that trigger the tautology rules
NAMES = {"tm": "thermal_load", "tr": "cooling_load", "tc": "temp_lag_1", "tout": "temp_lag_2", "fan": "delta_t"}
_NM = "CASE {v} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items()) + " END"
REPORT = f"{PV}, rp AS (SELECT {_NM.format(v='variable_1')} AS variable_1, {_NM.format(v='variable_2')} AS variable_2, r, n, p, abs(r) AS abs_r, (variable_1 || variable_2 IN ('tmtr', 'tctout')) AS is_tautology, p <= 0.3 AS is_significant FROM pv)"


def report(spark, sf):
    d = plant(spark, sf).withColumnsRenamed(NAMES)
    return correlate.pair_report(correlate.p_values(correlate.pearson_pairs(d, [], list(NAMES.values()))), 0.3)


@query("j07_pair_report", f"WITH {REPORT} SELECT variable_1, variable_2, round(r, 6) AS r, n, round(p, 6) AS p_value, round(abs_r, 6) AS abs_r, is_tautology, is_significant FROM rp")
def j07(spark, sf):
    return report(spark, sf)


@query("j07_top_pairs", f"WITH {REPORT} SELECT variable_1, variable_2, round(r, 6) AS r FROM rp WHERE NOT is_tautology AND is_significant ORDER BY r DESC LIMIT 3")
def j07_top(spark, sf):
    return correlate.top_pairs(report(spark, sf), 3).select("variable_1", "variable_2", "r")


@query("j08_strong_pairs", f"""
WITH {PLANT_SQL}, c AS (SELECT corr(tm, tm * 2 + tr / 50) AS r, count(*) FILTER (tm IS NOT NULL AND tr IS NOT NULL) AS n FROM plant) SELECT 'tm' AS variable_1, 'mix' AS variable_2, round(r, 6) AS r, n, abs(r) >= 0.9 AS is_multicollinear FROM c WHERE abs(r) >= 0.7""")
def j08(spark, sf):
    d = plant(spark, sf).withColumn("mix", F.col("tm") * 2 + F.col("tr") / 50)
    return correlate.strong_pairs(correlate.pearson_pairs(d, [], ["tm", "tout", "mix"], [("tm", "mix"), ("tm", "tout")]))


@query("j08_weak_variables", f"""
WITH {PEARSON}, b AS (SELECT variable_1 AS variable, abs(r) AS a FROM pr UNION ALL SELECT variable_2, abs(r) FROM pr) SELECT variable, round(sum(a) / 4, 6) AS mean_abs_r FROM b GROUP BY 1 HAVING sum(a) / 4 < 0.3""")
def j08_weak(spark, sf):
    return correlate.weak_variables(pearson(spark, sf), [], len(ALL))


LAGS = range(-4, 5)
_shift = lambda k: f"lag(v, {k}) OVER w" if k >= 0 else f"lead(v, {-k}) OVER w"


def _lag_sql(src):
    cols = ", ".join(f"{_shift(k)} AS s{k + 4}" for k in LAGS)
    return f"{src}, sh AS (SELECT event_type, k, {cols} FROM base WINDOW w AS (PARTITION BY event_type ORDER BY ts)), lg AS (" + " UNION ALL ".join(
        f"SELECT event_type, {k} AS lag, {k * 0.5} AS lag_hours, corr(s{k + 4}, k) AS r, count(s{k + 4}) AS n FROM sh GROUP BY 1" for k in LAGS) + ")"


BASE = f"{HALF_SQL}, base AS (SELECT event_type, ts, v, k FROM half WHERE v IS NOT NULL AND k IS NOT NULL)"
DIFF = f"""{HALF_SQL}, dv AS (SELECT event_type, ts, v - lag(v) OVER (PARTITION BY event_type ORDER BY ts) AS v FROM half WHERE v IS NOT NULL), dk AS (SELECT event_type, ts, k - lag(k) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM half WHERE k IS NOT NULL),
base AS (SELECT event_type, ts, v, k FROM dv JOIN dk USING (event_type, ts) WHERE v IS NOT NULL AND k IS NOT NULL)"""


@query("j09_lag_correlation", f"WITH {_lag_sql(BASE)} SELECT event_type, lag, CAST(lag_hours AS DOUBLE) AS lag_hours, round(r, 6) AS r, n FROM lg")
def j09(spark, sf):
    return correlate.lag_correlation(staged(half(spark, sf)), HALF, "v", "k", 4, 0.5)


@query("j09_lag_spearman", f"""
WITH {BASE}, sh AS (SELECT event_type, k, lag(v, 1) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM base), xy AS (SELECT event_type AS variable_1, '1' AS variable_2, s AS x, k AS y FROM sh WHERE s IS NOT NULL), {_RANK}
SELECT variable_1 AS event_type, round(r, 6) AS r, n FROM sp""")
def j09_spearman(spark, sf):
    d = correlate.lag_correlation(staged(half(spark, sf)), HALF, "v", "k", 1, 0.5, method="spearman", two_sided=False)
    return d.filter("lag = 1").select("event_type", "r", "n")


@query("j10_optimal_lag", f"""
WITH {_lag_sql(BASE)}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(r) DESC, lag) AS i FROM lg)
SELECT event_type, CAST(lag_hours AS DOUBLE) AS optimal_lag_hours, round(r, 6) AS optimal_r, n AS n_effective FROM o WHERE i = 1""")
def j10(spark, sf):
    return correlate.optimal_lag(j09(spark, sf), ["event_type"])


@query("j11_detrend_demean", f"WITH {HALF_SQL} SELECT event_type, ts, round(v - avg(v) OVER (PARTITION BY event_type), 6) AS v FROM half WHERE v IS NOT NULL")
def j11(spark, sf):
    return correlate.detrend(half(spark, sf), HALF, "v", "demean")


@query("j11_lag_of_differences", f"WITH {_lag_sql(DIFF)} SELECT event_type, lag, CAST(lag_hours AS DOUBLE) AS lag_hours, round(r, 6) AS r, n FROM lg")
def j11_diff(spark, sf):
    return correlate.lag_correlation(staged(half(spark, sf)), HALF, "v", "k", 4, 0.5, mode="diff")


@query("j12_lag_findings", f"""
WITH {_lag_sql(BASE)}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(r) DESC, lag) AS i FROM lg)
SELECT CASE event_type WHEN 'click' THEN 'Temperatura Esterna vs Ripresa' WHEN 'view' THEN 'setpoint_error vs Modulazione' WHEN 'error' THEN 'Mandata vs Ripresa' ELSE event_type END AS pair, CAST(lag_hours AS DOUBLE) AS optimal_lag_hours,
 CASE event_type WHEN 'click' THEN 'Thermal Response' WHEN 'view' THEN 'Control Latency' WHEN 'error' THEN 'Air Distribution' END AS finding FROM o WHERE i = 1""")
def j12(spark, sf):
    name = F.when(F.col("event_type") == "click", "Temperatura Esterna vs Ripresa").when(F.col("event_type") == "view", "setpoint_error vs Modulazione")
    d = j10(spark, sf).withColumn("pair", name.when(F.col("event_type") == "error", "Mandata vs Ripresa").otherwise(F.col("event_type")))
    return correlate.lag_findings(d).select("pair", "optimal_lag_hours", "finding")


@query("j13_feature_category", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Original Measurements' WHEN 1 THEN 'Temperature Features' WHEN 2 THEN 'Lag Features' WHEN 3 THEN 'Advanced Control Features' ELSE 'Cyclic Encoding' END AS category FROM part""")
def j13(spark, sf):
    from tidegrid.queries.inputs import table

    names = F.array(*[F.lit(x) for x in ("Umidita Esterna", "delta_t_signed", "v_lag_3", "cumulative_setpoint_error", "hour_sin")])
    d = table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("feature"))
    return d.select("p_partkey", importance.category("feature").alias("category"))


FEATS = ["tm", "tr", "tc"]
FSTAT = f"{PLANT_SQL}, fu AS (SELECT * FROM plant UNPIVOT INCLUDE NULLS (x FOR feature IN (tm, tr, tc))), fs AS (SELECT feature, 100.0 * avg(CAST(x IS NULL AS INT)) AS missing_pct, var_samp(x) AS variance, stddev_samp(x) AS std, avg(x) AS mean, 100.0 * stddev_samp(x) / avg(x) AS cv FROM fu GROUP BY 1)"


@query("j14_feature_stats", f"WITH {FSTAT} SELECT feature, round(missing_pct, 6) AS missing_pct, round(variance, 6) AS variance, round(std, 6) AS std, round(mean, 6) AS mean, round(cv, 6) AS cv FROM fs")
def j14(spark, sf):
    return importance.feature_stats(plant(spark, sf), FEATS)


TARGETS = [(f, t) for f in FEATS for t in ("tout", "fan")]
BEST = f"{_xy(TARGETS)}, {_RANK}, bt AS (SELECT variable_1 AS feature, max(abs(r)) AS max_abs_corr, arg_max(variable_2, abs(r)) AS best_target FROM sp GROUP BY 1)"


@query("j15_best_target", f"WITH {PLANT_SQL}, {BEST} SELECT feature, round(max_abs_corr, 6) AS max_abs_corr, best_target FROM bt")
def j15(spark, sf):
    return importance.best_target(importance.target_correlations(staged(plant(spark, sf)), FEATS, ["tout", "fan"]), ["tout", "fan"])


def _bin(c):
    return " + ".join(f"CAST({c} > quantile_cont({c}, {i / 10}) OVER () AS INT)" for i in range(1, 10))


MI = "cr AS (SELECT tm, tr, tc, tout FROM plant WHERE tm IS NOT NULL AND tr IS NOT NULL AND tc IS NOT NULL AND tout IS NOT NULL), bn AS (SELECT " + ", ".join(f"{_bin(c)} AS {c}" for c in ("tm", "tr", "tc", "tout")) + """ FROM cr),
bl AS (SELECT 'tm' AS feature, tm AS x, tout AS y FROM bn UNION ALL SELECT 'tr', tr, tout FROM bn UNION ALL SELECT 'tc', tc, tout FROM bn), jt AS (SELECT feature, x, y, count(*) AS n FROM bl GROUP BY 1, 2, 3),
jx AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM jt),
mi AS (SELECT feature, sum(n / t * ln(n * t / (nx * ny))) AS mutual_info FROM jx GROUP BY 1)"""


@query("j16_mutual_information", f"WITH {PLANT_SQL}, {MI} SELECT feature, round(mutual_info, 6) AS mutual_info FROM mi")
def j16(spark, sf):
    return importance.mutual_information(staged(plant(spark, sf)), FEATS, "tout")


@query("j17_forest_importance")
def j17(spark, sf):
    return importance.forest_importance(staged(plant(spark, sf)), ["tm", "tr", "tc", "fan"], "tout")


CLOCK = ["hour", "dow"]
CLOCK_SQL = f"{PLANT_SQL}, pc AS (SELECT tout, hour(ts)::DOUBLE AS hour, (isodow(ts) - 1)::DOUBLE AS dow FROM plant WHERE tout IS NOT NULL), {sqltails.two_level_tree('pc', CLOCK, 'tout', 'true')}, {sqltails.tree_importance(CLOCK)}"


@query("j17_single_tree_importance", f"WITH {CLOCK_SQL} SELECT feature, round(importance, 6) AS rf_importance FROM imp")
def j17_single(spark, sf):
    """One tree of depth two over all rows, whose splits SQL can search as well."""
    d = staged(plant(spark, sf)).withColumns({"hour": F.hour("ts").cast("double"), "dow": F.weekday("ts").cast("double")})
    return importance.forest_importance(d, CLOCK, "tout", trees=1, depth=2, bootstrap=False)


COMP = f"""{FSTAT}, {BEST}, {MI}, rp AS (SELECT fs.*, max_abs_corr, best_target, mutual_info, 0.3 * max_abs_corr + 0.35 * mutual_info / max(mutual_info) OVER () AS composite_score FROM fs JOIN bt USING (feature) JOIN mi USING (feature)),
rc AS (SELECT *, CASE WHEN missing_pct > 50 THEN 'REMOVE - High Missing Data' WHEN variance < 1e-10 THEN 'REMOVE - No Variation' WHEN composite_score > 0.5 THEN 'KEEP - High Importance' WHEN composite_score > 0.2 THEN 'CONSIDER - Medium Importance' ELSE 'REMOVE - Low Importance' END AS recommendation FROM rp)"""


def scored(spark, sf):
    d = staged(plant(spark, sf))
    best = importance.best_target(importance.target_correlations(d, FEATS, ["tout", "fan"]), ["tout", "fan"])
    return importance.composite(importance.assemble(importance.feature_stats(d, FEATS), best, importance.mutual_information(d, FEATS, "tout")))


@query("j18_composite_score", f"WITH {COMP} SELECT feature, round(composite_score, 6) AS composite_score, best_target, recommendation FROM rc")
def j18(spark, sf):
    return scored(spark, sf).select("feature", "composite_score", "best_target", "recommendation")


@query("j19_selected_features", f"WITH {COMP} SELECT feature, round(composite_score, 6) AS composite_score, recommendation FROM rc WHERE recommendation LIKE 'KEEP%' OR recommendation LIKE 'CONSIDER%'")
def j19(spark, sf):
    return importance.selected(scored(spark, sf))


@query("j19_recommendation_counts", f"WITH {COMP} SELECT recommendation, count(*) AS n FROM rc GROUP BY 1")
def j19_counts(spark, sf):
    return importance.recommendation_counts(scored(spark, sf))


