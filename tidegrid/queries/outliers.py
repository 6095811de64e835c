"""Queries for outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import outlier
from tidegrid.operators.outlier import Rules
from tidegrid.queries.inputs import EVENTS_SQL, HALF, HALF_SQL, events, half, staged
from tidegrid.queries.registry import query
from tidegrid.session import durable

KEY = ["event_type"]
LONG = f"""{HALF_SQL}, u AS (SELECT event_type, ts, 'v' AS variable, v AS value FROM half UNION ALL SELECT event_type, ts, 'k', k FROM half)"""
QUART = "q AS (SELECT event_type, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM u GROUP BY 1, 2)"
# absolute changes between known values
DIFF = "d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type, variable ORDER BY ts)) AS d FROM u WHERE value IS NOT NULL)"
STATES = "(abs(k - 10) <= 0.5 OR abs(k - 50) <= 0.5 OR abs(k - 90) <= 0.5)"


def flat(x):
    """Values in steps of 20, so that runs of equal values exist."""
    return F.floor(F.col(x) / 20) * 20


FLATSQL = f"""{HALF_SQL}, u AS (SELECT event_type, ts, 'f' AS variable, CAST(floor(k / 20) * 20 AS DOUBLE) AS value FROM half)"""


@query("g01_physical_limits", f"WITH {HALF_SQL} SELECT event_type, ts, v, coalesce(v < 5 OR v > 200, false) AS physical FROM half")
def g01(spark, sf):
    return half(spark, sf).select("event_type", "ts", "v", outlier.beyond("v", 5.0, 200.0).alias("physical"))


@query("g02_iqr_bounds", f"""
WITH {LONG}, {QUART} SELECT event_type, variable, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 3.5 * (q3 - q1), 6) AS lower, round(q3 + 3.5 * (q3 - q1), 6) AS upper FROM q""")
def g02(spark, sf):
    return outlier.iqr_bounds(half(spark, sf), KEY, ["v", "k"], 3.5)


@query("g02_iqr_flags", f"""
WITH {LONG}, {QUART} SELECT event_type, ts, v, coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false) AS v_iqr FROM half JOIN q USING (event_type) WHERE variable = 'v'""")
def g02_flags(spark, sf):
    return outlier.iqr_flags(half(spark, sf).select("event_type", "ts", "v"), KEY, ["v"], 1.5)


REGIME = """e AS (SELECT event_type, quantile_cont(k, 0.2) AS e1, quantile_cont(k, 0.4) AS e2, quantile_cont(k, 0.6) AS e3, quantile_cont(k, 0.8) AS e4 FROM half GROUP BY 1),
g AS (SELECT event_type, ts, v, k, CASE WHEN k IS NOT NULL THEN CAST(k > e1 AS INT) + CAST(k > e2 AS INT) + CAST(k > e3 AS INT) + CAST(k > e4 AS INT) END AS regime FROM half JOIN e USING (event_type)),
rb AS (SELECT event_type, regime, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM g WHERE regime IS NOT NULL GROUP BY 1, 2)"""


@query("g03_regime_iqr", f"""
WITH {HALF_SQL}, {REGIME} SELECT g.event_type, ts, v, k, coalesce(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1), false) AS iqr_regime
FROM g LEFT JOIN rb ON g.event_type = rb.event_type AND g.regime = rb.regime""")
def g03(spark, sf):
    return outlier.regime_iqr_flags(staged(half(spark, sf)), KEY, "v", "k", 1.5, 5)


@query("g04_valid_states", f"WITH {HALF_SQL} SELECT event_type, ts, k, NOT coalesce({STATES}, false) AS invalid FROM half")
def g04(spark, sf):
    return half(spark, sf).select("event_type", "ts", "k", outlier.not_a_state("k", (10, 50, 90), 0.5).alias("invalid"))


@query("g05_spikes_global", f"""
WITH {LONG}, {DIFF}, s AS (SELECT event_type, variable, 3.0 * stddev_samp(d) AS threshold FROM d GROUP BY 1, 2)
SELECT event_type, variable, ts, value, round(threshold, 6) AS threshold, coalesce(d > threshold, false) AS spike FROM d JOIN s USING (event_type, variable)""")
def g05(spark, sf):
    return outlier.spikes(staged(half(spark, sf)), HALF, ["v", "k"], 3.0)


ROLLED = """s AS (SELECT *, 2.0 * stddev_samp(d) OVER (PARTITION BY event_type, variable ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS threshold FROM d)"""


@query("g05_spikes_rolling", f"""
WITH {LONG}, {DIFF}, {ROLLED} SELECT event_type, variable, ts, value, round(threshold, 6) AS threshold, coalesce(d > threshold, false) AS spike FROM s""")
def g05_rolling(spark, sf):
    return outlier.spikes(staged(half(spark, sf)), HALF, ["v", "k"], 2.0, 12)


@query("g05_spike_thresholds", f"""
WITH {LONG}, {DIFF}, {ROLLED} SELECT event_type, variable, count(*) FILTER (d > threshold) AS n_spikes, round(quantile_cont(threshold, 0.5), 6) AS threshold FROM s GROUP BY 1, 2""")
def g05_thresholds(spark, sf):
    return outlier.spike_thresholds(outlier.spikes(staged(half(spark, sf)), HALF, ["v", "k"], 2.0, 12), KEY)


STUCK = f"""{FLATSQL}, {DIFF}, c AS (SELECT *, coalesce(d <= 0.01, false) AS flat FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - row_number() OVER (PARTITION BY event_type, flat ORDER BY ts) AS isl FROM c),
st AS (SELECT event_type, variable, ts, value, flat AND count(*) OVER (PARTITION BY event_type, flat, isl) >= 3 AS stuck FROM i)"""


@query("g06_stuck_values", f"WITH {STUCK} SELECT * FROM st")
def g06(spark, sf):
    return outlier.stuck(staged(half(spark, sf)).withColumn("f", flat("k")), HALF, ["f"], 3)


@query("g07_limit_resolution", f"""
WITH {LONG}, n AS (SELECT *, CASE WHEN variable = 'v' THEN 'Set Points Temperatura Mandata' ELSE 'Umidita Esterna' END AS name,
  CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'winter' ELSE 'spring' END AS season FROM u)
SELECT name, season, CASE WHEN variable = 'k' THEN 0e0 ELSE 15e0 END AS lo, CASE WHEN variable = 'k' THEN 100e0 WHEN season = 'winter' THEN 30e0 ELSE 21e0 END AS hi,
  count(*) FILTER (CASE WHEN variable = 'k' THEN value < 0 OR value > 100 ELSE value < 15 OR value > CASE WHEN season = 'winter' THEN 30 ELSE 21 END END) AS n_outside FROM n GROUP BY name, season, lo, hi""")
def g07(spark, sf):
    from tidegrid.plans.quantiles import melt

    d = half(spark, sf).withColumnsRenamed({"v": "Set Points Temperatura Mandata", "k": "Umidita Esterna"})
    d = melt(d, ["event_type", "ts"], ["Set Points Temperatura Mandata", "Umidita Esterna"])
    d = d.withColumn("season", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "winter").otherwise("spring"))
    lim = outlier.resolve_limits(F.col("variable"), F.col("season"))
    d = d.withColumn("lim", lim).withColumns({"lo": F.col("lim")[0], "hi": F.col("lim")[1]})
    return d.groupBy(F.col("variable").alias("name"), "season", "lo", "hi").agg(F.count_if(outlier.beyond("value", F.col("lo"), F.col("hi"))).alias("n_outside"))


@query("g08_value_kinds", f"""
WITH {EVENTS_SQL}, u AS (SELECT event_type, 'value' AS variable, value AS x FROM ev UNION ALL SELECT event_type, 'k', k FROM ev UNION ALL SELECT event_type, 'w', floor(value) FROM ev),
s AS (SELECT event_type, variable, count(DISTINCT x) AS unique_count, count(x) AS n FROM u GROUP BY 1, 2)
SELECT *, round(unique_count / n, 6) AS unique_ratio, CASE WHEN unique_count / n < 0.05 OR unique_count <= 10 THEN 'discrete' WHEN unique_count / n > 0.2 THEN 'continuous' ELSE 'mixed' END AS kind FROM s""")
def g08(spark, sf):
    return outlier.value_kinds(events(spark, sf).withColumn("w", F.floor("value")), KEY, ["value", "k", "w"])


RULES = {
    "v": Rules(limits=(1.0, 250.0), spike_k=3.0, iqr_k=1.5, regime_column="k", regime_bins=5),
    "k": Rules(states=(10.0, 50.0, 90.0)),
    "f": Rules(stuck_rows=3),
}
FLAG_SQL = f"""{HALF_SQL}, {REGIME}, q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM half GROUP BY 1),
dv AS (SELECT event_type, ts, abs(v - lag(v) OVER (PARTITION BY event_type ORDER BY ts)) AS d FROM half WHERE v IS NOT NULL),
sv AS (SELECT event_type, 3.0 * stddev_samp(d) AS thr FROM dv GROUP BY 1),
u AS (SELECT event_type, ts, 'f' AS variable, CAST(floor(k / 20) * 20 AS DOUBLE) AS value FROM half),
d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts)) AS d FROM u WHERE value IS NOT NULL), c AS (SELECT *, coalesce(d <= 0.01, false) AS flat FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - row_number() OVER (PARTITION BY event_type, flat ORDER BY ts) AS isl FROM c),
st AS (SELECT event_type, ts, flat AND count(*) OVER (PARTITION BY event_type, flat, isl) >= 3 AS stuck FROM i),
fl AS (SELECT h.event_type, h.ts, 'v' AS variable, h.v AS value, coalesce(h.v < 1 OR h.v > 250, false) AS physical, coalesce(dv.d > thr, false) AS spike, false AS stuck, false AS valid_state,
   coalesce(h.v < q.q1 - 1.5 * (q.q3 - q.q1) OR h.v > q.q3 + 1.5 * (q.q3 - q.q1), false) AS iqr, coalesce(h.v < rb.q1 - 1.5 * (rb.q3 - rb.q1) OR h.v > rb.q3 + 1.5 * (rb.q3 - rb.q1), false) AS iqr_regime
   FROM half h JOIN q USING (event_type) JOIN sv USING (event_type) LEFT JOIN dv ON dv.event_type = h.event_type AND dv.ts = h.ts
   JOIN g ON g.event_type = h.event_type AND g.ts = h.ts LEFT JOIN rb ON rb.event_type = g.event_type AND rb.regime = g.regime
 UNION ALL SELECT event_type, ts, 'k', k, false, false, false, NOT coalesce({STATES}, false), false, false FROM half
 UNION ALL SELECT h.event_type, h.ts, 'f', CAST(floor(h.k / 20) * 20 AS DOUBLE), false, false, coalesce(st.stuck, false), false, false, false FROM half h LEFT JOIN st ON st.event_type = h.event_type AND st.ts = h.ts),
flags AS (SELECT *, physical OR spike OR stuck OR valid_state AS hard, iqr OR iqr_regime AS soft, physical OR spike OR stuck OR valid_state OR iqr OR iqr_regime AS outlier FROM fl)"""


def _flags(spark, sf):
    return outlier.flag_table(durable(half(spark, sf).withColumn("f", flat("k").cast("double"))), HALF, RULES)


@query("g09_combined_flags", f"WITH {FLAG_SQL} SELECT * FROM flags")
def g09(spark, sf):
    return _flags(spark, sf)


@query("g10_outlier_summary", f"""
WITH {FLAG_SQL} SELECT event_type, variable, count(value) AS total_points, count(*) FILTER (outlier) AS outliers, round(100.0 * count(*) FILTER (outlier) / count(value), 6) AS outlier_pct,
 count(*) FILTER (hard) AS hard_outliers, round(100.0 * count(*) FILTER (hard) / count(value), 6) AS hard_pct, count(*) FILTER (soft) AS soft_flags, round(100.0 * count(*) FILTER (soft) / count(value), 6) AS soft_pct,
 count(*) FILTER (physical) AS n_physical, count(*) FILTER (spike) AS n_spike, count(*) FILTER (stuck) AS n_stuck, count(*) FILTER (valid_state) AS n_valid_state, count(*) FILTER (iqr) AS n_iqr,
 count(*) FILTER (iqr_regime) AS n_iqr_regime, CASE WHEN 100.0 * count(*) FILTER (hard) / count(value) > 10 THEN 'DROP' ELSE 'KEEP' END AS recommendation FROM flags GROUP BY 1, 2""")
def g10(spark, sf):
    return outlier.outlier_summary(_flags(spark, sf), KEY)


@query("g11_wide_flag_table", f"""
WITH {FLAG_SQL} SELECT event_type, ts, """ + ", ".join(
    f"max(CASE WHEN variable = '{c}' THEN {f} END) AS {c if f == 'value' else c + '_' + f}" for c in ("v", "k")
    for f in ("value", "outlier", "hard", "soft", "physical", "spike", "stuck", "valid_state", "iqr", "iqr_regime")) + " FROM flags GROUP BY 1, 2")
def g11(spark, sf):
    return outlier.wide_flags(_flags(spark, sf), HALF, ["v", "k"])


@query("g11_null_hard_outliers", f"""
WITH {FLAG_SQL} SELECT h.event_type, h.ts, CASE WHEN NOT hard THEN h.v END AS v FROM half h JOIN flags f ON f.event_type = h.event_type AND f.ts = h.ts AND variable = 'v'""")
def g11_null(spark, sf):
    return outlier.null_hard_outliers(staged(half(spark, sf)).select("event_type", "ts", "v"), _flags(spark, sf), HALF, ["v"])


@query("g12_statistical_counts", f"""
WITH {LONG}, {QUART}, m AS (SELECT event_type, variable, avg(value) AS mean, stddev_samp(value) AS sd FROM u GROUP BY 1, 2),
c AS (SELECT event_type, variable, count(value) AS n, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers, count(*) FILTER (abs((value - mean) / sd) > 3) AS z_outliers
 FROM u JOIN q USING (event_type, variable) JOIN m USING (event_type, variable) GROUP BY 1, 2)
SELECT *, round(100.0 * iqr_outliers / n, 6) AS iqr_pct, round(100.0 * z_outliers / n, 6) AS z_pct FROM c""")
def g12(spark, sf):
    return outlier.statistical_counts(staged(half(spark, sf)), KEY, ["v", "k"])


@query("g13_tukey_report", f"""
WITH {LONG}, {QUART}, b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT event_type, variable, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper, count(value) AS n, count(*) FILTER (value < lower OR value > upper) AS n_outside,
 min(value) FILTER (value BETWEEN lower AND upper) AS keep_from, max(value) FILTER (value BETWEEN lower AND upper) AS keep_to, round(100.0 * count(*) FILTER (value < lower OR value > upper) / count(value), 6) AS outside_pct
 FROM u JOIN b USING (event_type, variable) GROUP BY event_type, variable, q1, q3, lower, upper""")
def g13(spark, sf):
    return outlier.tukey_report(staged(half(spark, sf)), KEY, ["v", "k"])
