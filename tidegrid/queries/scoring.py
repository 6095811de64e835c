"""Queries for sequences, scoring, events and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.operators import anomaly, events, forecast, impute, joins, missing, sequence
from tidegrid.operators.anomaly import Detection
from tidegrid.plans.blocks import POSITION, positions
from tidegrid.plans.series import Series
from tidegrid.queries import sqltails
from tidegrid.queries.featuring import FULL_SQL, full
from tidegrid.queries.inputs import HALF, HALF_SQL, STEP, half, staged
from tidegrid.queries.registry import query
from tidegrid.session import durable

KEY = ["event_type"]
COLS = ["v", "k"]
SPARSE = Series(("event_type",), "ts")
W = "(PARTITION BY event_type ORDER BY ts)"


# ---------------------------------------------------------------- sequences

def _window_view(d, *extra):
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return d.select("event_type", "ts", F.get("window", F.lit(0)).alias("first_v"), F.element_at("window", -1).alias("last_k"), total.alias("total"), *extra)


WIN = """wn AS (SELECT *, lag(v, 3) OVER w AS first_v, lag(v, 3) OVER w + lag(v, 2) OVER w + lag(v, 1) OVER w + v + lag(k, 3) OVER w + lag(k, 2) OVER w + lag(k, 1) OVER w + k AS total,
 epoch_us(ts) - epoch_us(lag(ts, 3) OVER w) AS span, count(*) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n,
 min(CAST(clean AS INT)) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS all_clean,
 max(CAST(jump AS INT)) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS jumps
 FROM (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) > 2700000000, false) AS jump FROM src) WINDOW w AS (PARTITION BY event_type ORDER BY ts))"""
SRC = "src AS (SELECT event_type, ts, v, k, coalesce(k < 90, false) AS clean FROM half WHERE v IS NULL OR v < 150)"


def _windows(spark, sf):
    d = staged(half(spark, sf)).filter("v IS NULL OR v < 150").withColumn("ok", F.coalesce(F.col("k") < 90, F.lit(False)))
    return sequence.sliding_windows(d, HALF, COLS, 4, STEP, "ok")


@query("k01_sliding_windows", f"WITH {HALF_SQL}, {SRC}, {WIN} SELECT event_type, ts, first_v, k AS last_k, round(total, 6) AS total, all_clean = 1 AS clean FROM wn WHERE n = 4 AND total IS NOT NULL AND jumps = 0")
def k01(spark, sf):
    return _window_view(_windows(spark, sf), "clean")


@query("k02_plain_windows", f"WITH {FULL_SQL}, src AS (SELECT *, true AS clean FROM full_), {WIN} SELECT event_type, ts, first_v, k AS last_k, round(total, 6) AS total FROM wn WHERE n = 4")
def k02(spark, sf):
    return _window_view(sequence.plain_windows(full(spark, sf), HALF, COLS, 4))


SPLIT = """wk AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) // 604800000000 AS week FROM {src}),
nw AS (SELECT event_type, count(DISTINCT week) AS n FROM wk GROUP BY 1), rw AS (SELECT event_type, week, row_number() OVER (PARTITION BY event_type ORDER BY week) AS i FROM (SELECT DISTINCT event_type, week FROM wk)),
sp AS (SELECT wk.*, CASE WHEN i <= greatest(1, floor(n * 0.70)) THEN 'train' WHEN i <= greatest(1, floor(n * 0.70)) + greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'test' END AS split
 FROM wk JOIN nw USING (event_type) JOIN rw USING (event_type, week))"""


@query("k03_week_split", f"WITH {HALF_SQL}, {SPLIT.format(src='half')} SELECT event_type, ts, split FROM sp")
def k03(spark, sf):
    return sequence.split_by_week(half(spark, sf), HALF).select("event_type", "ts", "split")


@query("k04_cap_and_exclude", f"WITH {HALF_SQL} SELECT event_type, ts, v FROM half WHERE ts <= TIMESTAMP '2024-01-25' AND NOT ts BETWEEN TIMESTAMP '2024-01-06' AND TIMESTAMP '2024-01-08 12:00:00'")
def k04(spark, sf):
    return sequence.cap_and_exclude(half(spark, sf), "ts", "2024-01-25", [("2024-01-06", "2024-01-08 12:00:00")]).select("event_type", "ts", "v")


def _cstd(c, n, alias):
    b, a = n - 1 - (n - 1) // 2, (n - 1) // 2
    fr = f"(PARTITION BY event_type ORDER BY ts ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)"
    return f"CASE WHEN count({c}) OVER {fr} = {n} THEN stddev_samp({c}) OVER {fr} END AS {alias}"


@query("k05_flatline_rows", f"""
WITH {FULL_SQL}, c AS (SELECT *, {_cstd('k', 4, 'sk')}, {_cstd('v', 4, 'sv')} FROM full_), f AS (SELECT *, coalesce(sk < 15, false) AS fk, coalesce(sv < 3, false) AS fv FROM c) SELECT event_type, ts, fk OR fv AS is_flat FROM f""")
def k05(spark, sf):
    d = staged(full(spark, sf))
    a = sequence.flat_rows(d, HALF, ["k"], 4, 15.0, out="fk")
    return sequence.flat_rows(a, HALF, ["v"], 4, 3.0, out="fv").select("event_type", "ts", (F.col("fk") | F.col("fv")).alias("is_flat"))


def _train(spark, sf):
    d = staged(sequence.split_by_week(half(spark, sf), HALF))
    return d, d.filter("split = 'train'")


TR = f"{HALF_SQL}, {SPLIT.format(src='half')}, tr AS (SELECT * FROM sp WHERE split = 'train'), tu AS (SELECT event_type, 'v' AS variable, v AS value FROM tr UNION ALL SELECT event_type, 'k', k FROM tr)"
RB = "rb AS (SELECT event_type, variable, quantile_cont(value, 0.5) AS center, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS scale FROM tu GROUP BY 1, 2)"


@query("k06_robust_scaler", f"WITH {TR}, {RB} SELECT event_type, variable, round(center, 6) AS center, round(scale, 6) AS scale FROM rb")
def k06(spark, sf):
    return sequence.fit_scaler(_train(spark, sf)[1], KEY, COLS)


@query("k06_standard_minmax", f"""
WITH {TR} SELECT event_type, variable, 'standard' AS kind, round(avg(value), 6) AS center, round(stddev_pop(value), 6) AS scale FROM tu GROUP BY 1, 2
UNION ALL SELECT event_type, variable, 'minmax', min(value), round(max(value) - min(value), 6) FROM tu GROUP BY 1, 2""")
def k06_other(spark, sf):
    tr = _train(spark, sf)[1]
    a, b = (sequence.fit_scaler(tr, KEY, COLS, k).withColumn("kind", F.lit(k)) for k in ("standard", "minmax"))
    return a.unionByName(b)


@query("k06_scaled_series", f"""
WITH {TR}, {RB} SELECT sp.event_type, ts, split, round((v - a.center) / a.scale, 6) AS v, round((k - b.center) / b.scale, 6) AS k FROM sp
JOIN rb a ON a.event_type = sp.event_type AND a.variable = 'v' JOIN rb b ON b.event_type = sp.event_type AND b.variable = 'k'""")
def k06_scaled(spark, sf):
    d, tr = _train(spark, sf)
    return sequence.scale(d, sequence.fit_scaler(tr, KEY, COLS), KEY, COLS)


@query("k07_scaled_variance", f"""
WITH {TR}, {RB}, s AS (SELECT event_type, variable, var_samp(value) AS x FROM tu GROUP BY 1, 2) SELECT event_type, variable, round(x / (scale * scale), 6) AS scaled_variance, x / (scale * scale) >= 0.6 AS keep FROM s JOIN rb USING (event_type, variable)""")
def k07(spark, sf):
    tr = _train(spark, sf)[1]
    return sequence.scaled_variance(tr, sequence.fit_scaler(tr, KEY, COLS), KEY, COLS, 0.6)


@query("k08_inactive_mask", f"WITH {HALF_SQL} SELECT event_type, ts, NOT (coalesce(k >= 5, false) OR coalesce(v >= 5, false)) AS is_inactive FROM half")
def k08(spark, sf):
    return sequence.inactive(half(spark, sf), ["k", "v"]).select("event_type", "ts", "is_inactive")


@query("k09_long_flat_runs", f"""
WITH {FULL_SQL}, c AS (SELECT *, {_cstd('k', 4, 'sk')} FROM full_), f AS (SELECT *, coalesce(sk < 30, false) AS fk FROM c),
i AS (SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY event_type, fk ORDER BY ts) AS isl FROM f) SELECT event_type, ts, fk AND count(*) OVER (PARTITION BY event_type, fk, isl) >= 4 AS is_long_flat FROM i""")
def k09(spark, sf):
    return sequence.long_flat_runs(staged(full(spark, sf)), HALF, ["k"], 4, 30.0).select("event_type", "ts", "is_long_flat")


@query("k10_interpolated_mask", f"""
WITH {FULL_SQL}, c AS (SELECT *, {_cstd('v', 6, 'sv')} FROM full_), f AS (SELECT *, coalesce(sv < 12, false) AS fv FROM c) SELECT event_type, ts, fv AS is_filled FROM f""")
def k10(spark, sf):
    return sequence.interpolated_rows(staged(full(spark, sf)), HALF, [], ["v"], 6, 12.0).select("event_type", "ts", "is_filled")


@query("k11_out_of_range", f"""
WITH {HALF_SQL}, q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM half GROUP BY 1)
SELECT event_type, ts, coalesce(v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1), false) AS beyond_iqr, coalesce(v < 2 OR v > 180, false) OR coalesce(k < 3 OR k > 97, false) AS is_out_of_range FROM half JOIN q USING (event_type)""")
def k11(spark, sf):
    d = sequence.out_of_range(staged(half(spark, sf)), KEY, ["v"], None, "beyond_iqr")
    return sequence.out_of_range(d, KEY, COLS, {"v": (2, 180), "k": (3, 97)}).select("event_type", "ts", "beyond_iqr", "is_out_of_range")


@query("k12_high_variance", f"""
WITH {FULL_SQL}, c AS (SELECT *, {_cstd('v', 12, 'sv')} FROM full_), g AS (SELECT event_type, stddev_samp(v) AS sg FROM full_ GROUP BY 1), f AS (SELECT *, coalesce(sv > 1.5 * sg, false) AS fv FROM c JOIN g USING (event_type)) SELECT event_type, ts, fv AS is_noisy FROM f""")
def k12(spark, sf):
    return sequence.high_variance(staged(full(spark, sf)), HALF, ["v"], 12, 1.5).select("event_type", "ts", "is_noisy")


@query("k13_transients", f"""
WITH {HALF_SQL}, b AS (SELECT *, coalesce(k > 50, false) AS a_on, coalesce(k <= 50, false) AS a_off FROM half),
t AS (SELECT *, CAST(coalesce(abs(v - lag(v) OVER {W}) >= 90, false) OR (a_on AND lag(a_on) OVER {W} = false) OR (a_off AND lag(a_off) OVER {W} = false) AS INT) AS t FROM b)
SELECT event_type, ts, coalesce(max(t) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1, false) AS is_transient FROM t""")
def k13(spark, sf):
    return sequence.transients(half(spark, sf), HALF, ["v"], ["k"], 90.0, 50.0).select("event_type", "ts", "is_transient")


@query("k14_clean_windows", f"WITH {HALF_SQL}, {SRC}, {WIN} SELECT event_type, ts, round(total, 6) AS total FROM wn WHERE n = 4 AND total IS NOT NULL AND jumps = 0 AND all_clean = 1")
def k14(spark, sf):
    return _window_view(sequence.clean_windows(_windows(spark, sf))).select("event_type", "ts", "total")


MAD = f"""{FULL_SQL}, src AS (SELECT *, true AS clean FROM full_), m AS (SELECT event_type, ts, avg(v) OVER w AS a, avg(k) OVER w AS b, count(*) OVER w AS n FROM src WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
c AS (SELECT event_type, quantile_cont(a, 0.5) AS ca, quantile_cont(b, 0.5) AS cb FROM m WHERE n = 4 GROUP BY 1), d AS (SELECT m.*, abs(a - ca) AS da, abs(b - cb) AS db FROM m JOIN c USING (event_type) WHERE n = 4),
e AS (SELECT event_type, quantile_cont(da, 0.5) + 1e-8 AS ma, quantile_cont(db, 0.5) + 1e-8 AS mb FROM d GROUP BY 1), z AS (SELECT d.event_type, ts, greatest(da / ma, db / mb) AS z FROM d JOIN e USING (event_type)), q AS (SELECT event_type, quantile_cont(z, 0.95) AS cut FROM z GROUP BY 1)"""


@query("k15_mad_filter", f"WITH {MAD} SELECT event_type, ts, round(z, 5) AS max_z, z > cut AS is_extreme FROM z JOIN q USING (event_type)", digits=5)
def k15(spark, sf):
    w = sequence.plain_windows(staged(full(spark, sf)), HALF, COLS, 4)
    return sequence.mad_filter(w, HALF, 2, 4).drop("window")


@query("k16_inverse_scaling", f"WITH {HALF_SQL} SELECT event_type, ts, v, k FROM half")
def k16(spark, sf):
    d, tr = _train(spark, sf)
    p = sequence.fit_scaler(tr, KEY, COLS)
    return sequence.scale(sequence.scale(d, p, KEY, COLS), p, KEY, COLS, inverse=True).select("event_type", "ts", "v", "k")


# ---------------------------------------------------------------- scoring

P = Detection(span=10.0, k=1.2, grace=20, persistence=2, candidate_persistence=2)
SCORED = f"{HALF_SQL}, {SPLIT.format(src='half')}, sc AS (SELECT event_type, ts, v AS score, v, k, split FROM sp WHERE v IS NOT NULL)"


def scored(spark, sf):
    d = sequence.split_by_week(half(spark, sf), HALF).filter("v IS NOT NULL")
    # the chain below reads its scores many times: stored once, as a stage table
    return durable(d.withColumn("score", F.col("v")))


def _ewm(name, src, keys, x, brk="false"):
    """Recursive exponential moments of ``x`` over ``src`` per key."""
    on = " AND ".join(f"r.{k} = e.{k}" for k in keys)
    ks, rks = ", ".join(keys), ", ".join(f"r.{k}" for k in keys)
    a = "(2.0 / 11)"
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY ts) AS i, {brk} AS brk FROM {src}),
{name}_e AS (SELECT {ks}, i, {x} AS m, 0.0::DOUBLE AS s2, 1.0::DOUBLE AS w2, 1 AS c FROM {name}_r WHERE i = 1 UNION ALL
 SELECT {rks}, r.i, CASE WHEN r.brk THEN r.{x} ELSE e.m + {a} * (r.{x} - e.m) END, CASE WHEN r.brk THEN 0.0 ELSE (1 - {a}) * (e.s2 + {a} * (r.{x} - e.m) * (r.{x} - e.m)) END,
 CASE WHEN r.brk THEN 1.0 ELSE (1 - {a}) * (1 - {a}) * e.w2 + {a} * {a} END, CASE WHEN r.brk THEN 1 ELSE e.c + 1 END FROM {name}_e e JOIN {name}_r r ON {on} AND r.i = e.i + 1),
{name} AS (SELECT r.*, e.m, CASE WHEN e.c > 1 THEN sqrt(e.s2 / (1 - e.w2)) END AS sd FROM {name}_r r JOIN {name}_e e ON {on} AND r.i = e.i)"""


ANCHOR = f"""trs AS (SELECT * FROM sc WHERE split = 'train'), {_ewm('ta', 'trs', ['event_type'], 'score')},
tstd AS (SELECT event_type, stddev_pop(score) AS train_std FROM trs GROUP BY 1),
anc AS (SELECT event_type, arg_max(m, i) + 1.2 * coalesce(arg_max(sd, i), max(train_std)) AS anchor, max(train_std) AS train_std FROM ta JOIN tstd USING (event_type) GROUP BY 1)"""
SMOOTH = "sm AS (SELECT *, quantile_cont(score, 0.5) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM sc)"
DYN = f"""{SCORED}, {ANCHOR}, {SMOOTH}, {_ewm('de', 'sm', ['event_type'], 'smoothed', "coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) > 3600000000, false)")},
dt AS (SELECT event_type, ts, score, v, k, split, i, smoothed, CASE WHEN i = 1 OR brk THEN anchor ELSE lag(m + 1.2 * coalesce(sd, train_std)) OVER (PARTITION BY event_type ORDER BY ts) END AS threshold FROM de JOIN anc USING (event_type))"""


def _anchor(d):
    return anomaly.ema_anchor(d.filter("split = 'train'").select("event_type", "ts", "score"), SPARSE, "score", P.span, P.k)


def dynamic(spark, sf, d=None):
    d = scored(spark, sf) if d is None else d
    # numbered once: every later step of the chain keeps all rows
    numbered = positions(d, SPARSE, POSITION)
    return anomaly.dynamic_threshold(anomaly.smooth_scores(numbered, SPARSE), SPARSE, _anchor(d), "smoothed", P.span, P.k, 1.0)


@query("l01_linear_autoencoder")
def l01(spark, sf):
    """Fit on clean training windows, rebuild every window, mean error per split."""
    d = sequence.split_by_week(staged(half(spark, sf)), HALF)
    ks = Series(("event_type", "split"), "ts", STEP)
    w = sequence.sliding_windows(d, ks, COLS, 4, STEP)
    model = anomaly.fit_reconstruction(w.filter("split = 'train'"), 3, 8)
    r = model.apply(w).withColumn("score", anomaly.window_score("window", "rebuilt"))
    return r.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_mae"))


# windows of one row of two features: the strongest direction has the angle atan2(2 cov, var - var) / 2
AXIS = f"""{HALF_SQL}, {SPLIT.format(src='half')}, w1 AS (SELECT h.event_type, h.ts, h.v, h.k, sp.split FROM half h JOIN sp ON sp.event_type = h.event_type AND sp.ts = h.ts WHERE h.v IS NOT NULL AND h.k IS NOT NULL),
ax AS (SELECT avg(v) AS mv, avg(k) AS mk, atan2(2 * covar_pop(v, k), var_pop(v) - var_pop(k)) / 2 AS angle FROM w1 WHERE split = 'train'),
pj AS (SELECT w1.*, mv, mk, angle, (v - mv) * cos(angle) + (k - mk) * sin(angle) AS z FROM w1, ax),
rb AS (SELECT event_type, ts, split, (abs(v - mv - z * cos(angle)) + abs(k - mk - z * sin(angle))) / 2 AS score FROM pj)"""


@query("l01_axis_reconstruction", f"WITH {AXIS} SELECT event_type, ts, split, round(score, 6) AS score FROM rb")
def l01_axis(spark, sf):
    """Windows of one row, rebuilt along the strongest direction of the training windows."""
    d = sequence.split_by_week(staged(half(spark, sf)), HALF)
    w = sequence.sliding_windows(d, Series(("event_type", "split"), "ts", STEP), COLS, 1, STEP)
    r = anomaly.fit_reconstruction(w.filter("split = 'train'"), 1, 2).apply(w)
    return r.select("event_type", "ts", "split", anomaly.window_score("window", "rebuilt").alias("score"))


def _rebuilt(spark, sf):
    """Windows with their own mean as the simplest reconstruction."""
    w = sequence.plain_windows(staged(full(spark, sf)), HALF, COLS, 4)
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / 8
    return w.withColumn("rebuilt", F.array_repeat(mean, 8))


RBW = f"""{FULL_SQL}, wv AS (SELECT event_type, ts, list(v) OVER w AS vs, list(k) OVER w AS ks FROM full_ WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
wm AS (SELECT *, (list_sum(vs) + list_sum(ks)) / 8 AS mu FROM wv WHERE len(vs) = 4)"""


@query("l02_window_scores", f"""
WITH {RBW}, e AS (SELECT event_type, ts, list_sum(list_transform(list_concat(vs, ks), lambda x: abs(x - mu))) / 8 AS mae, list_sum(list_transform(list_concat(vs, ks), lambda x: (x - mu) * (x - mu))) / 8 AS mse FROM wm)
SELECT event_type, ts, round(mae, 9) AS mae, round(sqrt(mse), 6) AS rmse FROM e""", digits=9)
def l02(spark, sf):
    d = _rebuilt(spark, sf)
    return d.select("event_type", "ts", *[F.round(anomaly.window_score("window", "rebuilt", m), n).alias(m) for m, n in (("mae", 9), ("rmse", 6))])


@query("l03_feature_scores", f"""
WITH {RBW} SELECT event_type, ts, round(list_sum(list_transform(vs, lambda x: abs(x - mu))) / 4, 6) AS v_error, round(list_sum(list_transform(ks, lambda x: abs(x - mu))) / 4, 6) AS k_error FROM wm""")
def l03(spark, sf):
    d = _rebuilt(spark, sf)
    return d.select("event_type", "ts", *[anomaly.feature_score("window", "rebuilt", i, 2, 4).alias(f"{c}_error") for i, c in enumerate(COLS)])


@query("l04_static_thresholds", f"""
WITH {SCORED} SELECT event_type, 'percentile' AS mode, round(quantile_cont(score, 0.95), 6) AS threshold FROM sc WHERE split = 'train' GROUP BY 1
UNION ALL SELECT event_type, 'sigma', round(avg(score) + 3 * stddev_pop(score), 6) FROM sc WHERE split = 'train' GROUP BY 1""")
def l04(spark, sf):
    tr = scored(spark, sf).filter("split = 'train'")
    a = anomaly.percentile_threshold(tr, KEY).withColumn("mode", F.lit("percentile"))
    return a.unionByName(anomaly.sigma_threshold(tr, KEY).withColumn("mode", F.lit("sigma")))


@query("l04_ema_anchor", f"WITH RECURSIVE {SCORED}, {ANCHOR} SELECT event_type, round(anchor, 6) AS anchor, round(train_std, 6) AS train_std FROM anc")
def l04_ema(spark, sf):
    return _anchor(scored(spark, sf))


@query("l05_smoothed_scores", f"WITH {SCORED}, {SMOOTH} SELECT event_type, ts, round(smoothed, 6) AS smoothed FROM sm")
def l05(spark, sf):
    return anomaly.smooth_scores(scored(spark, sf), SPARSE).select("event_type", "ts", "smoothed")


@query("l06_dynamic_threshold", f"WITH RECURSIVE {DYN} SELECT event_type, ts, round(smoothed, 6) AS smoothed, round(threshold, 6) AS threshold FROM dt")
def l06(spark, sf):
    return dynamic(spark, sf).select("event_type", "ts", "smoothed", "threshold")


@query("l07_occupied_mask", f"WITH {HALF_SQL} SELECT event_type, ts, hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) < 6 AS occupied, hour(ts) >= 22 OR hour(ts) < 6 AS night FROM half")
def l07(spark, sf):
    return half(spark, sf).select("event_type", "ts", anomaly.occupied_mask("ts").alias("occupied"), anomaly.occupied_mask("ts", 22, 6, True).alias("night"))


@query("l08_mode_aware_threshold", f"WITH RECURSIVE {DYN} SELECT event_type, ts, round(threshold * CASE WHEN hour(ts) >= 8 AND hour(ts) < 18 AND isodow(ts) < 6 THEN 0.95 ELSE 1.05 END, 6) AS threshold FROM dt")
def l08(spark, sf):
    return anomaly.mode_aware(dynamic(spark, sf), anomaly.occupied_mask("ts")).select("event_type", "ts", "threshold")


FLAG = f"{DYN}, fl AS (SELECT *, smoothed > threshold AND i > 20 AS flag FROM dt)"


def flagged(spark, sf, d=None):
    return anomaly.flag_scores(dynamic(spark, sf, d), SPARSE, "smoothed", "threshold", P.grace)


@query("l09_flags_with_grace", f"WITH RECURSIVE {FLAG} SELECT event_type, ts, flag FROM fl")
def l09(spark, sf):
    return flagged(spark, sf).select("event_type", "ts", "flag")


def _keep(src, flag, n, out, tag):
    return f"""{tag}_i AS (SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY event_type, {flag} ORDER BY ts) AS isl_{tag} FROM {src}),
{tag} AS (SELECT *, {flag} AND count(*) OVER (PARTITION BY event_type, {flag}, isl_{tag}) >= {n} AS {out} FROM {tag}_i)"""


PERS = f"{FLAG}, {_keep('fl', 'flag', 2, 'anomaly', 'pk')}"


def detected(spark, sf, d=None):
    return anomaly.persistent(flagged(spark, sf, d), SPARSE, {"anomaly": ("flag", P.persistence), "candidate": ("flag", 1)})


@query("l10_persistence", f"WITH RECURSIVE {PERS} SELECT event_type, ts, flag, anomaly FROM pk")
def l10(spark, sf):
    return detected(spark, sf).select("event_type", "ts", "flag", "anomaly")


THR = "ft AS (SELECT event_type, quantile_cont(v, 0.9) AS v_thr, quantile_cont(k, 0.9) AS k_thr FROM sc WHERE split = 'train' GROUP BY 1)"


def with_feature_thresholds(spark, sf):
    """Detected rows with the per-feature thresholds of the training rows."""
    d = scored(spark, sf)
    thr = anomaly.feature_thresholds(d.filter("split = 'train'"), KEY, COLS, 90.0)
    return detected(spark, sf, d).join(thr, KEY)


@query("l11_candidates", f"WITH RECURSIVE {FLAG}, {THR} SELECT event_type, ts, flag AND CAST(coalesce(v > v_thr, false) AS INT) + CAST(coalesce(k > k_thr, false) AS INT) >= 1 AS candidate FROM fl JOIN ft USING (event_type)")
def l11(spark, sf):
    d = with_feature_thresholds(spark, sf)
    return d.select("event_type", "ts", (F.col("candidate") & (anomaly.count_anomalous(COLS) >= 1)).alias("candidate"))


_SPS = "sps AS (SELECT *, quantile_cont(score, 0.5) OVER (PARTITION BY event_type, split ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM sc)"


@query("l12_split_rates", f"""
WITH RECURSIVE {SCORED}, {ANCHOR}, {_SPS}, {_ewm('se', 'sps', ['event_type', 'split'], 'smoothed')},
st AS (SELECT *, CASE WHEN i = 1 THEN anchor ELSE lag(m + 1.2 * coalesce(sd, train_std)) OVER (PARTITION BY event_type, split ORDER BY ts) END AS threshold FROM se JOIN anc USING (event_type)),
sf AS (SELECT *, smoothed > threshold AND i > 20 AS f FROM st), si AS (SELECT *, row_number() OVER (PARTITION BY event_type, split ORDER BY ts) - row_number() OVER (PARTITION BY event_type, split, f ORDER BY ts) AS isl FROM sf),
sk AS (SELECT *, f AND count(*) OVER (PARTITION BY event_type, split, f, isl) >= 2 AS a FROM si) SELECT event_type, split, count(*) AS n, round(100.0 * avg(CAST(a AS INT)), 6) AS anomaly_rate FROM sk GROUP BY 1, 2""")
def l12(spark, sf):
    d = scored(spark, sf)
    return anomaly.split_rates(d, SPARSE, _anchor(d), "split", P)


@query("l13_feature_thresholds", f"WITH {SCORED}, {THR} SELECT event_type, round(v_thr, 6) AS v_thr, round(k_thr, 6) AS k_thr FROM ft")
def l13(spark, sf):
    return anomaly.feature_thresholds(scored(spark, sf).filter("split = 'train'"), KEY, COLS, 90.0)


@query("l13_anchored_thresholds", f"""
WITH RECURSIVE {SCORED}, {ANCHOR} SELECT event_type, round(avg(v) * max(anchor) / (avg(score) + 1e-9), 6) AS v_thr, round(avg(k) * max(anchor) / (avg(score) + 1e-9), 6) AS k_thr FROM trs JOIN anc USING (event_type) GROUP BY 1""")
def l13_anchored(spark, sf):
    d = scored(spark, sf)
    return anomaly.anchored_feature_thresholds(d.filter("split = 'train'"), _anchor(d), KEY, COLS)


CLASS = f"""{PERS}, {THR}, cl AS (SELECT *, CAST(coalesce(v > v_thr, false) AS INT) + CAST(coalesce(k > k_thr, false) AS INT) AS n_anomalous FROM pk JOIN ft USING (event_type)),
cs AS (SELECT *, anomaly AND n_anomalous >= 1 AS kp, CASE WHEN anomaly AND n_anomalous >= 1 THEN CASE WHEN score > 2.5 * threshold THEN 'Critical' WHEN score > 1.5 * threshold THEN 'Moderate' ELSE 'Minor' END ELSE 'Normal' END AS severity FROM cl)"""


@query("l14_severity", f"WITH RECURSIVE {CLASS} SELECT event_type, ts, n_anomalous, severity, kp AND severity <> 'Minor' AS filtered FROM cs")
def l14(spark, sf):
    d = with_feature_thresholds(spark, sf)
    return anomaly.classify(d, COLS, drop_minor=True).select("event_type", "ts", "n_anomalous", "severity", "filtered")


@query("l15_transition_guard", f"""
WITH {SCORED}, q AS (SELECT event_type, quantile_cont(k, 0.7) AS lim FROM sc WHERE split = 'train' GROUP BY 1), l AS (SELECT *, v - lag(v) OVER {W} AS a, lead(v) OVER {W} - v AS b FROM sc),
g AS (SELECT *, abs(coalesce((a + b) / 2, b, a)) AS g FROM l) SELECT event_type, ts, v > 60 AND coalesce(g > 20, false) AND coalesce(k < lim, false) AS suppressed, v > 60 AND NOT (coalesce(g > 20, false) AND coalesce(k < lim, false)) AS filtered FROM g JOIN q USING (event_type)""")
def l15(spark, sf):
    d = scored(spark, sf).withColumn("filtered", F.col("v") > 60)
    lim = anomaly.percentile_threshold(d.filter("split = 'train'"), KEY, "k", 70.0).withColumnRenamed("threshold", "limit")
    return anomaly.transition_guard(d, SPARSE, "v", "k", lim, "filtered", 20.0).select("event_type", "ts", "suppressed", "filtered")


FAULT = f"""{FULL_SQL}, a AS (SELECT event_type, ts, v, k, v > 60 AS f, v + 1e-9 AS cur, coalesce(abs(v - lag(v) OVER {W}), 0) AS ds, coalesce(abs(k - lag(k) OVER {W}), 0) AS dr FROM full_),
j AS (SELECT a.event_type, a.ts, quantile_cont(b.v, 0.5) + 1e-9 AS prev, bool_or(b.f) AS seen, bool_or(b.v >= a.cur / 1.5) AS high FROM a LEFT JOIN a b ON a.event_type = b.event_type AND b.ts BETWEEN a.ts - INTERVAL '25 hours' AND a.ts - INTERVAL '23 hours' GROUP BY 1, 2),
p AS (SELECT a.*, f AND coalesce(greatest(cur, prev) / least(cur, prev) <= 1.5 AND (seen OR high), false) AS is_periodic, abs(v - (v + k / 20)) >= 2 OR (ds >= 1 AND dr <= 0.25) AS breaks_physics FROM a JOIN j USING (event_type, ts)),
lb AS (SELECT *, CASE WHEN f AND is_periodic AND NOT breaks_physics THEN 'Operational peak' WHEN f THEN 'Potential fault' ELSE 'Normal' END AS label, f AND NOT is_periodic AS kept FROM p)"""


def faults(spark, sf):
    d = staged(full(spark, sf)).withColumns({"f": F.col("v") > 60, "coil": F.col("v") + F.col("k") / 20})
    return anomaly.label_faults(d, HALF, "f", "v", "v", "k", "coil")


@query("l16_periodic_or_fault", f"WITH {FAULT} SELECT event_type, ts, is_periodic, breaks_physics, label, kept FROM lb")
def l16(spark, sf):
    return faults(spark, sf).select("event_type", "ts", "is_periodic", "breaks_physics", "label", "kept")


EV = f"""{FULL_SQL}, ef AS (SELECT event_type, ts, v, k, v > 45 AS f, CASE WHEN v > 150 THEN 'Potential fault' WHEN v > 45 THEN 'Operational peak' ELSE 'Normal' END AS label,
 CASE WHEN v > 200 THEN 'Critical' WHEN v > 100 THEN 'Moderate' WHEN v > 45 THEN 'Minor' ELSE 'Normal' END AS severity, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY event_type) AS nn FROM full_),
e1 AS (SELECT *, i - row_number() OVER (PARTITION BY event_type, f ORDER BY ts) AS s1 FROM ef), e2 AS (SELECT *, count(*) OVER q AS ln, min(i) OVER q AS lo, max(i) OVER q AS hi FROM e1 WINDOW q AS (PARTITION BY event_type, f, s1)),
e3 AS (SELECT *, f OR (ln <= 1 AND lo > 1 AND hi < nn) AS b FROM e2), e4 AS (SELECT *, i - row_number() OVER (PARTITION BY event_type, b ORDER BY ts) AS s2 FROM e3),
e5 AS (SELECT *, count(*) OVER (PARTITION BY event_type, b, s2) AS ln2 FROM e4), e6 AS (SELECT *, lag(i) OVER {W} AS pi, lag(ts) OVER {W} AS pts, lag(v) OVER {W} AS pv FROM e5 WHERE b AND ln2 >= 3),
e7 AS (SELECT *, pi IS NULL OR (pi <> i - 1 AND epoch_us(ts) - epoch_us(pts) > 3600000000) AS brk FROM e6), e8 AS (SELECT *, sum(CAST(brk AS INT)) OVER {W} AS ev FROM e7),
evs AS (SELECT event_type, CAST(ev AS BIGINT) AS event_id, min(ts) AS start, max(ts) AS "end", count(*) AS n_windows, max(v) AS peak_score, arg_max(ts, struct_pack(v := v, t := -epoch_us(ts))) AS peak_ts,
 CASE WHEN bool_or(label = 'Potential fault') THEN 'Potential fault' ELSE 'Operational transient' END AS event_type_2, arg_max(severity, CASE severity WHEN 'Critical' THEN 4 WHEN 'Moderate' THEN 3 WHEN 'Minor' THEN 2 ELSE 1 END) AS severity,
 avg(abs(v - k / 2)) AS a, avg(abs(v - k)) AS b, coalesce(max(CASE WHEN NOT brk THEN abs(v - pv) END), 0) AS c FROM e8 GROUP BY event_type, ev)"""


def _event_input(spark, sf):
    v = F.col("v")
    return staged(full(spark, sf)).withColumns({
        "f": v > 45, "coil": F.col("k") / 2,
        "label": F.when(v > 150, "Potential fault").when(v > 45, "Operational peak").otherwise("Normal"),
        "severity": F.when(v > 200, "Critical").when(v > 100, "Moderate").when(v > 45, "Minor").otherwise("Normal"),
    })


def _events(spark, sf):
    d = _event_input(spark, sf)
    # the key of these series is itself called event_type
    return events.events(d.withColumnRenamed("event_type", "series"), Series(("series",), "ts", STEP), "f", "v", "label", "severity", 0.5, "v", "k", "coil", 3, 1, 1.0)


@query("l17_events", f"""
WITH {EV} SELECT event_type AS series, event_id, start, "end", n_windows, peak_score, peak_ts, event_type_2 AS event_type, severity, n_windows * 0.5e0 AS duration_h,
 round(a, 6) AS supply_coil_mean_abs, round(b, 6) AS supply_return_mean_abs, round(c, 6) AS supply_change_max FROM evs""")
def l17(spark, sf):
    return _events(spark, sf)


@query("l18_episode_stats", f"""
WITH {FULL_SQL}, f AS (SELECT *, v > 45 AS f FROM full_), i AS (SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY event_type, f ORDER BY ts) AS s FROM f), e AS (SELECT event_type, count(*) AS n FROM i WHERE f GROUP BY event_type, s)
SELECT event_type, count(*) AS n_episodes, round(avg(n), 6) AS mean_windows, max(n) AS max_windows, round(avg(n) * 0.5, 6) AS mean_hours, max(n) * 0.5e0 AS max_hours FROM e GROUP BY 1""")
def l18(spark, sf):
    return events.episode_stats(staged(full(spark, sf)).withColumn("f", F.col("v") > 45), HALF, "f", 0.5)


@query("l19_gap_diagnostic", f"""
WITH {HALF_SQL}, m AS (SELECT *, v IS NULL AS g, lag(v IS NULL) OVER {W} AS p, lead(v IS NULL) OVER {W} AS x FROM half), e AS (SELECT event_type, ts FROM m WHERE g AND (p IS DISTINCT FROM true OR x IS DISTINCT FROM true)),
a AS (SELECT event_type, ts, g FROM m WHERE coalesce(v > 60, false) OR (g AND hour(ts) = 12)), n AS (SELECT *, g OR EXISTS (SELECT 1 FROM e WHERE e.event_type = a.event_type AND e.ts BETWEEN a.ts - INTERVAL '1 hour' AND a.ts + INTERVAL '1 hour') AS near FROM a)
SELECT event_type, count(*) AS n_anomalies, count(*) FILTER (near) AS n_gap_adjacent, round(100.0 * count(*) FILTER (near) / count(*), 6) AS gap_adjacent_pct, count(*) FILTER (NOT near) AS n_genuine FROM n GROUP BY 1""")
def l19(spark, sf):
    d = staged(half(spark, sf)).withColumn("f", F.coalesce(F.col("v") > 60, F.lit(False)) | (F.col("v").isNull() & (F.hour("ts") == 12)))
    gaps = missing.gap_durations(d, HALF, ["v"]).drop("variable")
    return events.gap_diagnostic(d, HALF, "f", gaps, d.filter("v IS NULL"), STEP)


QUAL = f"""{HALF_SQL}, qs AS (SELECT event_type, 'v' AS feature, v AS a, k AS b FROM half UNION ALL SELECT event_type, 'k', k, v / 2 FROM half),
qq AS (SELECT event_type, feature, count(a - b) AS n, 1 - avg((a - b) ** 2) / var_pop(CASE WHEN b IS NOT NULL THEN a END) AS r2, sqrt(avg((a - b) ** 2)) AS rmse, avg((a - b) ** 2) AS mse, avg(abs(a - b)) AS mae FROM qs GROUP BY 1, 2)"""


def _quality(spark, sf):
    return anomaly.quality(half(spark, sf).withColumn("h", F.col("v") / 2), KEY, {"v": ("v", "k"), "k": ("k", "h")})


@query("l20_quality", f"WITH {QUAL} SELECT event_type, feature, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mse, 6) AS mse, round(mae, 6) AS mae FROM qq")
def l20(spark, sf):
    return _quality(spark, sf)


@query("l20_overall_quality", f"WITH {QUAL} SELECT event_type, round(avg(r2), 6) AS r2, round(sqrt(sum(mse * n) / sum(n)), 6) AS rmse, round(sum(mse * n) / sum(n), 6) AS mse, round(sum(mae * n) / sum(n), 6) AS mae FROM qq GROUP BY 1")
def l20_overall(spark, sf):
    return anomaly.overall_quality(_quality(spark, sf), KEY)


RULE = f"""{HALF_SQL}, rl AS (SELECT *, avg(abs(v - 50)) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS e FROM half),
ru AS (SELECT event_type, ts, coalesce(v - k < 0.5 AND k > 30, false) AS rule_low_delta, coalesce(e > 40, false) AS rule_setpoint FROM rl)"""


@query("l21_physics_rules", f"WITH {RULE} SELECT * FROM ru")
def l21(spark, sf):
    d = half(spark, sf).withColumns({"sp": F.lit(50.0), "fan": F.col("k")})
    return anomaly.physics_rules(d, HALF, "v", "k", "sp", "fan", max_error=40.0).select("event_type", "ts", "rule_low_delta", "rule_setpoint")


@query("l22_result_table", f"""
WITH {EV} SELECT h.event_type AS series, h.ts, h.v, coalesce(event_id, 0) AS event_id, coalesce(event_type_2, 'None') AS event_type, h.v > 45 AND h.k > 80 AS anomaly_and_rule
FROM full_ h LEFT JOIN evs ON evs.event_type = h.event_type AND h.ts BETWEEN start AND "end\"""")
def l22(spark, sf):
    d = _event_input(spark, sf).withColumnRenamed("event_type", "series").withColumns({"kept": F.col("f"), "rule": F.col("k") > 80})
    return events.result_table(d, _events(spark, sf), Series(("series",), "ts", STEP), ["rule"]).select("series", "ts", "v", "event_id", "event_type", "anomaly_and_rule")


CAND = f"""{FULL_SQL}, f AS (SELECT *, v > 45 AS f, greatest(v - 40, 0) AS ex, CAST(k > 50 AS INT) AS nf FROM full_), i AS (SELECT *, row_number() OVER {W} - row_number() OVER (PARTITION BY event_type, f ORDER BY ts) AS s FROM f),
ce AS (SELECT event_type, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_rows, max(v) AS peak_score, 40e0 AS peak_threshold, max(ex) AS max_exceedance, avg(ex) AS mean_exceedance, avg(nf) AS mean_features, count(*) * 0.5e0 AS duration_h FROM i WHERE f GROUP BY event_type, s),
cd AS (SELECT *, 0.45 * max_exceedance + 0.30 * mean_exceedance + 0.15 * duration_h + 0.10 * mean_features AS candidate_score FROM ce)"""


def _candidates(spark, sf):
    d = staged(full(spark, sf)).withColumns({"f": F.col("v") > 45, "thr": F.lit(40.0), "nf": (F.col("k") > 50).cast("int")})
    return events.candidate_events(d, HALF, "f", "v", "thr", "nf")


@query("l23_candidate_events", f"""
WITH {CAND} SELECT event_type, start_time, end_time, n_rows, peak_score, peak_threshold, round(max_exceedance, 6) AS max_exceedance, round(mean_exceedance, 6) AS mean_exceedance, round(mean_features, 6) AS mean_features,
 duration_h, CAST(hour(start_time) AS INT) AS start_hour, CAST(hour(end_time) AS INT) AS end_hour, round(candidate_score, 6) AS candidate_score FROM cd""")
def l23(spark, sf):
    return _candidates(spark, sf)


@query("l23_top_candidates", f"WITH {CAND} SELECT event_type, start_time, n_rows, round(candidate_score, 6) AS candidate_score FROM cd ORDER BY cd.candidate_score DESC, max_exceedance DESC, duration_h DESC, start_time LIMIT 10")
def l23_top(spark, sf):
    return events.ranked(_candidates(spark, sf), 10).select("event_type", "start_time", "n_rows", "candidate_score")


@query("l24_anomaly_context", f"""
WITH {HALF_SQL}, q AS (SELECT event_type, quantile_cont(v, 0.9) AS c FROM half WHERE v > 60 GROUP BY 1), a AS (SELECT event_type, ts, v FROM half JOIN q USING (event_type) WHERE v > 60 AND v >= c)
SELECT a.event_type, a.ts AS anchor_ts, a.v AS anchor_score, h.ts, h.v FROM a JOIN half h ON h.event_type = a.event_type AND h.ts BETWEEN a.ts - INTERVAL '3 hours' AND a.ts + INTERVAL '3 hours'""")
def l24(spark, sf):
    d = staged(half(spark, sf)).select("event_type", "ts", "v")
    a = anomaly.context_anchors(d.withColumn("f", F.coalesce(F.col("v") > 60, F.lit(False))), KEY, "f", "v")
    return joins.context(a, d, HALF, 10_800).select("event_type", "anchor_ts", "anchor_score", "ts", "v")


@query("l25_last_step", f"WITH {RBW} SELECT event_type, ts, vs[4] AS v, ks[4] AS k, round(mu, 8) AS v_rebuilt, round(mu, 8) AS k_rebuilt FROM wm", digits=8)
def l25(spark, sf):
    d = _rebuilt(spark, sf)
    return d.select("event_type", "ts", *anomaly.last_step("window", COLS), *anomaly.last_step("rebuilt", COLS, "_rebuilt"))


# ---------------------------------------------------------------- forecasting

COMPLETE = f"{HALF_SQL}, m1 AS (SELECT event_type, ts, k, v FROM half WHERE k IS NOT NULL AND v IS NOT NULL)"
M2 = f"""{COMPLETE}, mi AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM m1),
ms AS (SELECT event_type, ts, k, v, CASE WHEN i < floor(n * 0.70) THEN 'train' WHEN i < floor(n * 0.70) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM mi)"""
M3 = f"{M2}, mp AS (SELECT event_type, avg(k) AS mu, stddev_pop(k) AS sd FROM ms WHERE split = 'train' GROUP BY 1), mz AS (SELECT ms.event_type, ts, split, v, (k - mu) / sd AS k FROM ms JOIN mp USING (event_type))"
M4 = f"{M3}, mf AS (SELECT regr_slope(v, k) AS b, regr_intercept(v, k) AS a FROM mz WHERE split = 'train'), mq AS (SELECT mz.*, a + b * k AS prediction FROM mz, mf)"


def complete(spark, sf):
    return forecast.select_complete(staged(half(spark, sf)), HALF, ["k"], "v")


def prepared(spark, sf):
    return forecast.standardise(forecast.split_rows(complete(spark, sf), SPARSE), KEY, ["k"])


def linear(spark, sf):
    return forecast.fit_all(prepared(spark, sf), ["k"], "v", {"linear": forecast.models()["linear"]})


@query("m01_complete_rows", f"WITH {COMPLETE} SELECT * FROM m1")
def m01(spark, sf):
    return complete(spark, sf)


@query("m02_row_split", f"WITH {M2} SELECT event_type, ts, k, v, split FROM ms")
def m02(spark, sf):
    return forecast.split_rows(complete(spark, sf), SPARSE)


@query("m03_standard_scaling", f"WITH {M3} SELECT event_type, ts, split, v, round(k, 6) AS k FROM mz")
def m03(spark, sf):
    return prepared(spark, sf)


@query("m04_linear_regression", f"WITH {M4} SELECT event_type, ts, split, round(prediction, 6) AS prediction FROM mq")
def m04(spark, sf):
    return linear(spark, sf)[1].select("event_type", "ts", "split", "prediction")


def _features(spark, sf):
    """Complete rows with calendar features beside the second signal."""
    d = staged(half(spark, sf)).withColumns({"hour": F.hour("ts").cast("double"), "dow": F.weekday(F.col("ts")).cast("double")})
    return forecast.split_rows(forecast.select_complete(d, HALF, ["k", "hour", "dow"], "v"), SPARSE)


@query("m05_random_forest")
def m05(spark, sf):
    _, p = forecast.fit_all(_features(spark, sf), ["k", "hour", "dow"], "v", {"forest": forecast.models()["forest"]})
    return forecast.evaluate(p)


CLOCK = ["hour", "dow"]
_TRAIN = "split = 'train'"
MC = f"""{HALF_SQL}, mh AS (SELECT event_type, ts, hour(ts)::DOUBLE AS hour, (isodow(ts) - 1)::DOUBLE AS dow, v FROM half WHERE v IS NOT NULL AND k IS NOT NULL),
mi AS (SELECT *, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM mh),
mt AS (SELECT event_type, ts, hour, dow, v, CASE WHEN i < floor(n * 0.70) THEN 'train' WHEN i < floor(n * 0.70) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM mi)"""
MTREE = f"{MC}, {sqltails.two_level_tree('mt', CLOCK, 'v', _TRAIN)}"


@query("m05_single_tree", f"""
WITH {MTREE}, m AS (SELECT half_, leaf, avg(v) AS prediction FROM leafed WHERE split = 'train' GROUP BY 1, 2)
SELECT event_type, ts, split, round(prediction, 6) AS prediction FROM leafed JOIN m USING (half_, leaf)""")
def m05_single(spark, sf):
    """One tree of depth two over all training rows, whose splits SQL can search as well."""
    forest = forecast.models(trees=1, forest_depth=2, bootstrap=False)["forest"]
    _, p = forecast.fit_all(_features(spark, sf), CLOCK, "v", {"forest": forest})
    return p.select("event_type", "ts", "split", "prediction")


@query("m06_two_rounds", f"""
WITH {MC}, t1 AS (SELECT * FROM mt WHERE {_TRAIN}), {sqltails.best_split('one', 't1', CLOCK, 'v')}, s1 AS (SELECT mt.*, {sqltails.side(CLOCK)} AS a FROM mt, one),
p1 AS (SELECT s1.*, m FROM s1 JOIN (SELECT a, avg(v) AS m FROM s1 WHERE {_TRAIN} GROUP BY 1) USING (a)), t2 AS (SELECT *, 2 * (v - m) AS rest FROM p1 WHERE {_TRAIN}),
{sqltails.best_split('two', 't2', CLOCK, 'rest')}, s2 AS (SELECT p1.*, {sqltails.side(CLOCK)} AS b FROM p1, two),
p2 AS (SELECT s2.*, step FROM s2 JOIN (SELECT b, avg(2 * (v - m)) AS step FROM s2 WHERE {_TRAIN} GROUP BY 1) USING (b))
SELECT event_type, ts, split, round(m + 0.1 * step, 6) AS prediction FROM p2""")
def m06_two(spark, sf):
    """Two rounds of boosted stumps over all training rows: the second learns from twice the first one's residuals."""
    boosting = forecast.models(rounds=2, boost_depth=1, subsample=1.0)["boosting"]
    _, p = forecast.fit_all(_features(spark, sf), CLOCK, "v", {"boosting": boosting})
    return p.select("event_type", "ts", "split", "prediction")


@query("m06_gradient_boosting")
def m06(spark, sf):
    _, p = forecast.fit_all(_features(spark, sf), ["k", "hour", "dow"], "v", {"boosting": forecast.models()["boosting"]})
    return forecast.evaluate(p)


EVAL = "me AS (SELECT 'linear' AS model, split, count(*) AS n, sqrt(avg((v - prediction) ** 2)) AS rmse, avg(abs(v - prediction)) AS mae, 1 - avg((v - prediction) ** 2) / var_pop(v) AS r2 FROM mq GROUP BY 2)"


@query("m07_model_metrics", f"WITH {M4}, {EVAL} SELECT model, split, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM me")
def m07(spark, sf):
    return forecast.evaluate(linear(spark, sf)[1])


_PICK = ", ".join(f"round(max(CASE WHEN split = '{s}' THEN {m} END), 6) AS {s}_{m}" for s in ("train", "val", "test") for m in ("rmse", "mae", "r2"))


@query("m08_model_comparison", f"""
WITH {M4}, {EVAL}, d AS (SELECT max(CASE WHEN split = 'train' THEN r2 END) - max(CASE WHEN split = 'test' THEN r2 END) AS x FROM me)
SELECT model, {_PICK}, round(max(x), 6) AS r2_drop, CASE WHEN max(x) > 0.15 THEN 'high' WHEN max(x) > 0.08 THEN 'moderate' ELSE 'low' END AS overfit FROM me, d GROUP BY model""")
def m08(spark, sf):
    return forecast.compare(forecast.evaluate(linear(spark, sf)[1]))


@query("m09_residuals", f"WITH {M4} SELECT event_type, ts, 'linear' AS model, v AS y, round(prediction, 6) AS prediction, round(v - prediction, 6) AS residual, round(abs(v - prediction), 6) AS abs_residual FROM mq")
def m09(spark, sf):
    return forecast.with_residuals(linear(spark, sf)[1]).select("event_type", "ts", "model", "y", "prediction", "residual", "abs_residual")


@query("m10_tree_importance")
def m10(spark, sf):
    feats = ["k", "hour", "dow"]
    d = _features(spark, sf)
    fitted, _ = forecast.fit_all(d, feats, "v", {"forest": forecast.models()["forest"]})
    return forecast.importances(fitted, d, feats)


@query("m10_single_tree_importance", f"WITH {MTREE}, {sqltails.tree_importance(CLOCK)} SELECT 'forest' AS model, feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY imp.importance DESC, feature) AS rank FROM imp")
def m10_single(spark, sf):
    d = _features(spark, sf)
    fitted, _ = forecast.fit_all(d, CLOCK, "v", {"forest": forecast.models(trees=1, forest_depth=2, bootstrap=False)["forest"]})
    return forecast.importances(fitted, d, CLOCK)


@query("m11_axis_search", f"WITH {AXIS} SELECT 1 AS length, 1 AS bottleneck, round(avg(score), 6) AS val_mae, count(*) AS n_windows FROM rb WHERE split = 'val'")
def m11_axis(spark, sf):
    """The search over one length and one bottleneck, whose direction has a closed form."""
    return forecast.search(sequence.split_by_week(staged(half(spark, sf)), HALF), HALF, COLS, STEP, [1], [1])


@query("m11_window_model_search")
def m11(spark, sf):
    d = impute.interpolate_time(staged(half(spark, sf)), HALF, COLS, 8)
    d = sequence.split_by_week(staged(d.select("event_type", "ts", *COLS)), HALF)
    return forecast.search(d, HALF, COLS, STEP)
