"""Operators against pandas or plain loops on small frames."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import roles, special
from tidegrid.operators import grid as grid_ops
from tidegrid.operators import anomaly, clean, correlate, events, features, impute, joins, missing, outlier, profiles, sequence, stats
from tidegrid.plans.series import Series
from tidegrid.session import durable
from tidegrid.sources import csv, sinks

RNG = np.random.default_rng(11)
S = Series(("k",), "ts", 1800)


def grid(n=300, holes=0.3, seed=1):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(20, 3, n), 2)
    v[r.random(n) < holes] = np.nan
    return pd.DataFrame({"k": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="30min"), "v": v})


def collect(df, by=("k", "ts")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def put(spark, pdf):
    return spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in pdf.columns if pdf[c].dtype == float})


def test_csv_dialects_units_and_hint(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿sep=,\n"Time", "Temp"\n"2024-01-01 00:00:00","21.3 °C"\n2024-01-01 00:30:00,"1,5 °C"\n'.encode())
    (tmp_path / "b.csv").write_text("Time;Temp;X;Y\n2024-01-01 00:00:00;22,5 Â°C;1;2\n2024-01-01 00:30:00;bad;1;2\n", encoding="utf-8")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    lines = csv.read_lines(spark, paths)
    d = {r.file.rsplit("/", 1)[1]: (r.sep, r.skip) for r in csv.sniff(lines).collect()}
    assert d == {"a.csv": (",", 1), "b.csv": (";", 0)}
    got = clean.clean_units(csv.read_export(spark, paths, ["Time", "Temp"]), ["Temp"]).select("Time", "Temp").collect()
    assert sorted(r.Temp for r in got if r.Temp is not None) == [1.5, 21.3, 22.5]
    assert sum(r.Temp is None for r in got) == 1


def test_dst_fold_and_hole(spark):
    rows = [("2025-10-26 02:30:00", 1), ("2025-10-26 02:30:00", 2), ("2025-10-26 01:30:00", 3), ("2025-10-26 03:00:00", 4), ("2025-03-30 02:30:00", 5), ("2025-07-01 12:00:00", 6), ("2025-07-01 12:00:00", 7)]
    d = spark.createDataFrame(rows, "t string, i int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.i: str(r.u) for r in clean.localize(d, Series((), "ts", None, ("i",)), "Europe/Rome").select("i", F.date_format("instant", "yyyy-MM-dd HH:mm").alias("u")).collect()}
    # both rows of a duplicate outside the fold keep the same offset
    assert got == {1: "2025-10-26 00:30", 2: "2025-10-26 01:30", 3: "2025-10-25 23:30", 4: "2025-10-26 02:00", 5: "2025-03-30 01:00", 6: "2025-07-01 10:00", 7: "2025-07-01 10:00"}


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_interpolation_matches_pandas(spark, limit):
    pdf = grid(holes=0.6)
    pdf.loc[:6, "v"] = np.nan
    pdf.loc[290:, "v"] = np.nan
    got = collect(impute.interpolate_time(put(spark, pdf), S, ["v"], limit))
    exp = pdf.set_index("ts").v.interpolate("time", limit=limit, limit_direction="both")
    np.testing.assert_allclose(got.v, exp)
    got = collect(impute.fill_steps(put(spark, pdf), S, ["v"], limit))
    np.testing.assert_allclose(got.v, pdf.v.ffill(limit=limit).bfill(limit=limit))


def test_gap_safe_fill_invariants(spark):
    pdf = grid(holes=0.5)
    got = collect(impute.gap_safe_fill(put(spark, pdf), S, ["v"], 1.5))
    known = pdf.v.notna()
    np.testing.assert_array_equal(got.v[known], pdf.v[known])
    runs = (known != known.shift()).cumsum()
    long_gap = ~known & (known.groupby(runs).transform("size") >= 3)
    assert got.v[long_gap].isna().all() and got.v[~long_gap].notna().all()
    np.testing.assert_array_equal(got.v_is_interpolated, ~known & ~long_gap)


@pytest.mark.parametrize("span", [3.0, 10.0])
def test_ewm_matches_pandas(spark, span):
    pdf = grid(3000, 0.0)
    got = collect(anomaly.ewm_statistics(put(spark, pdf), S, "v", span))
    e = pdf.v.ewm(span=span, adjust=False)
    np.testing.assert_allclose(got.ewm_mean, e.mean(), rtol=1e-12)
    np.testing.assert_allclose(got.ewm_std, e.std(), rtol=1e-9)
    flat = put(spark, pdf.assign(v=7.3))
    assert collect(anomaly.ewm_statistics(flat, S, "v", span)).ewm_std.dropna().eq(0).all()


def test_spikes_and_stuck(spark):
    pdf = grid(400, 0.1)
    pdf.loc[100:130, "v"] = 5.0
    d = put(spark, pdf)
    valid = pdf.dropna().set_index("ts").v
    diff = valid.diff().abs()
    got = collect(outlier.spikes(d, S, ["v"], 2.0))
    np.testing.assert_array_equal(got.spike, diff > 2.0 * diff.std())
    got = collect(outlier.spikes(d, S, ["v"], 2.0, 12))
    np.testing.assert_array_equal(got.spike, diff > 2.0 * diff.rolling(12, min_periods=1).std())
    flat = diff <= 0.01
    runs = (flat != flat.shift()).cumsum()
    got = collect(outlier.stuck(d, S, ["v"], 10))
    np.testing.assert_array_equal(got.stuck, flat & (flat.groupby(runs).transform("size") >= 10))
    assert got.stuck.sum() == 30


def test_regime_bins_match_qcut(spark):
    pdf = pd.DataFrame({"k": "a", "ts": range(500), "x": np.where(RNG.random(500) < 0.5, 1.0, RNG.normal(size=500)), "v": RNG.normal(size=500)})
    got = collect(outlier.regime_id(spark.createDataFrame(pdf), ["k"], "x", 5)).sort_values("ts")
    np.testing.assert_array_equal(got.regime, pd.qcut(pdf.x, 5, duplicates="drop", labels=False))


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_matches_pandas(spark, direction):
    a = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(RNG.choice(900_000, 200, False)), unit="s")})
    b = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(RNG.choice(900_000, 150, False)), unit="s")})
    b.loc[5, "ts"] = a.ts[7]
    b = b.drop_duplicates("ts").sort_values("ts")
    b["w"] = np.arange(len(b), dtype=float)
    from tidegrid.plans.asof import asof

    got = asof(spark.createDataFrame(a), spark.createDataFrame(b), Series(), ["w"], direction, 7200).toPandas().sort_values("ts")
    exp = pd.merge_asof(a.astype({"ts": "datetime64[us]"}), b.astype({"ts": "datetime64[us]"}), on="ts", direction=direction, tolerance=pd.Timedelta("2h"))
    np.testing.assert_allclose(got.w.to_numpy(float), exp.w.to_numpy(float))


def brute_events(ts, flag, bridge, min_len, merge_h):
    """Plain walk over the rows: bridge, keep long runs, merge near ones."""
    f, n = list(flag), len(flag)
    edges = [i for i in range(n) if f[i]]
    for a, b in zip(edges, edges[1:]):
        if 1 < b - a <= bridge + 1:
            f[a + 1 : b] = [True] * (b - a - 1)
    runs, i = [], 0
    while i < n:
        j = i
        while j < n and f[j]:
            j += 1
        if j - i >= min_len:
            runs.append([i, j - 1])
        i = max(j, i + 1)
    merged = []
    for r in runs:
        if merged and ts[r[0]] - ts[merged[-1][-1]] <= pd.Timedelta(hours=merge_h):
            merged[-1] += r
        else:
            merged.append(list(r))
    return [(ts[m[0]], ts[m[-1]], sum(m[x + 1] - m[x] + 1 for x in range(0, len(m), 2))) for m in merged]


@pytest.mark.parametrize("drop", [0.0, 0.1])
@pytest.mark.parametrize("merge_h", [1.0, 2.5])
def test_events_match_loop(spark, drop, merge_h):
    n = 600
    pdf = pd.DataFrame({"k": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="30min"), "f": RNG.random(n) < 0.55, "v": RNG.random(n), "label": "Normal", "severity": "Normal"})
    pdf = pdf[RNG.random(n) >= drop].reset_index(drop=True)
    s = S if drop == 0 else S.with_step(None)
    got = events.events(spark.createDataFrame(pdf), s, "f", "v", "label", "severity", 0.5, min_len=3, bridge_len=2, merge_hours=merge_h)
    got = got.toPandas().sort_values("start")
    exp = brute_events(list(pdf.ts), list(pdf.f), 2, 3, merge_h)
    assert [(a, b, c) for a, b, c in zip(got.start, got.end, got.n_windows)] == exp
    assert list(got.event_id) == list(range(1, len(exp) + 1))


def test_windows_skip_holes_and_jumps(spark):
    pdf = grid(120, 0.05)
    pdf = pdf.drop(index=range(40, 44)).reset_index(drop=True)
    got = collect(sequence.sliding_windows(put(spark, pdf), S, ["v"], 4, 1800))
    exp = [
        (pdf.ts[i], list(pdf.v[i - 3 : i + 1])) for i in range(3, len(pdf))
        if pdf.v[i - 3 : i + 1].notna().all() and (pdf.ts[i] - pdf.ts[i - 3]) == pd.Timedelta("90min")
    ]
    assert [(t, list(w)) for t, w in zip(got.ts, got.window)] == exp


def test_week_split_is_ordered(spark):
    got = collect(sequence.split_by_week(put(spark, grid(48 * 60)), S))
    order = got.split.map({"train": 0, "val": 1, "test": 2})
    assert order.is_monotonic_increasing and set(order) == {0, 1, 2}
    assert got.groupby("split").size().to_dict() == {"train": 48 * 42, "val": 48 * 7, "test": 48 * 11}


def test_correlations_match_pandas(spark):
    n = 400
    x = RNG.normal(size=n).round(1)
    pdf = pd.DataFrame({"k": "a", "x": x, "y": (x + RNG.normal(size=n)).round(1), "z": RNG.normal(size=n)})
    pdf.loc[::7, "y"] = np.nan
    d = put(spark, pdf)
    for fn, method in ((correlate.pearson_pairs, "pearson"), (correlate.spearman_pairs, "spearman")):
        for r in fn(d, ["k"], ["x", "y", "z"]).collect():
            both = pdf[[r.variable_1, r.variable_2]].dropna()
            rank = both.rank() if method == "spearman" else both
            assert r.n == len(both)
            np.testing.assert_allclose(r.r, np.corrcoef(rank.T)[0, 1], atol=1e-12)


def test_tail_probabilities(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (1.959963984540054,), (-3.5,), (5.0,)], "z double")
    got = d.select(special.normal_cdf(F.col("z")).alias("p")).toPandas().p
    np.testing.assert_allclose(got, [0.5, 0.8413447460685429, 0.975, 0.00023262907903552504, 0.9999997133484281], rtol=1e-12)
    d = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (12.706204736432095, 1.0), (1.0, 1e6)], "t double, df double")
    got = d.select(special.t_two_sided(F.col("t"), F.col("df")).alias("p")).toPandas().p
    np.testing.assert_allclose(got, [0.07338803477074039, 1.0, 0.05, 0.3173107], rtol=1e-5)


def test_two_group_tests_on_known_sample(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (4, 6, 8, 10, 12)]
    r = stats.compare_groups(spark.createDataFrame(rows, "g string, v double"), [], "g", "a", "b", ["v"]).first()
    assert (r.n_a, r.n_b, r.mean_diff) == (5, 5, -5.0)
    np.testing.assert_allclose([r.t_stat, r.u_stat, r.ks_stat], [-5 / np.sqrt(0.5 + 2), 1.5, 0.8], rtol=1e-12)
    np.testing.assert_allclose(r.cohens_d, -5 / np.sqrt((2.5 + 10) / 2))


def test_hot_key_block_results_do_not_depend_on_blocks(spark):
    """One key with almost all rows: features, masks and runs are the same for any block length."""
    from tidegrid.plans import blocks

    pdf = grid(1500, 0.3)
    pdf = pd.concat([pdf, pdf.head(20).assign(k="b")])
    d = put(spark, pdf)
    one = lambda rows: blocks.rolling(d, S, 11, 3, lambda w: {"m": F.avg("v").over(w.rowsBetween(-11, 3))}, rows=rows)
    pd.testing.assert_frame_equal(collect(one(10)), collect(one(10_000)))


def test_setpoint_and_profiles(spark):
    pdf = grid(48 * 14, 0.1).assign(sp=20.0)
    pdf.loc[::5, "sp"] = np.nan
    r = profiles.pair_kpis(put(spark, pdf), S, "v", "sp", 2, 2.0037).first()
    e = pdf.v.rolling(2, center=True, min_periods=1).mean() - pdf.sp.ffill().rolling(2, center=True, min_periods=1).mean()
    np.testing.assert_allclose([r.mae, r.rmse, r.bias, r.std_dev], [e.abs().mean(), np.sqrt((e**2).mean()), e.mean(), e.std(ddof=0)])
    np.testing.assert_allclose(r.time_in_band_pct, 100 * (e.abs() <= 2.0037).mean())


def test_missing_periods_add_one_mean_step(spark):
    pdf = grid(100, 0.0)
    pdf.loc[10:19, "v"] = np.nan
    pdf.loc[50, "v"] = np.nan
    got = missing.missing_periods(put(spark, pdf), S, ["v"], 4.0).collect()
    assert len(got) == 1 and got[0].duration_hours == 5.0 and got[0].missing_records == 10 and got[0].severity == "Minor"
    assert sorted(r.gap_hours for r in missing.gap_durations(put(spark, pdf), S, ["v"]).collect()) == [0.0, 4.5]


def test_join_falls_back_only_below_the_match_rate(spark):
    ts = pd.date_range("2024-01-01", periods=10, freq="30min")
    left = spark.createDataFrame(pd.DataFrame({"ts": ts}))
    near = spark.createDataFrame(pd.DataFrame({"ts": ts[:10:2] + pd.Timedelta("5min"), "w": np.arange(5.0)}))
    got = joins.two_step_join(left, near, Series(), ["w"], 600).toPandas()
    assert got.w.notna().sum() == 5
    exact = spark.createDataFrame(pd.DataFrame({"ts": ts[:9], "w": np.arange(9.0)}))
    got = joins.two_step_join(left, exact, Series(), ["w"], 7200).toPandas()
    assert got.w.notna().sum() == 9


def test_names_and_schedules():
    assert roles.rename_map(["temp", "rh", "Temp. Mandata"], roles.WEATHER_NAMES, roles.DISPLAY_NAMES) == {"temp": "Temperatura Esterna", "rh": "Umidita Esterna", "Temp. Mandata": "Temperatura Mandata"}
    assert roles.fill_role("Set Points Temperatura Mandata") == "step" and roles.fill_role("Temperatura Ripresa") == "sensor"
    assert features.parse_days("mon-fri") == [0, 1, 2, 3, 4] and features.parse_days("sat-mon") == [5, 6, 0] and features.parse_days("mon, wed") == [0, 2]
    assert features.season_setpoint("winter", ["Set Points Temperatura Mandata", "Set Points Temperatura Compensata"]) == "Set Points Temperatura Compensata"
    assert profiles.centred(2) == (1, 0) and profiles.centred(3) == (1, 1) and profiles.centred(12) == (6, 5)


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.005, 1), ("b", 2.344, 2)], "k string, v double, n int")
    sinks.write_full_and_rounded(d, str(tmp_path / "t"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "t/rounded")).orderBy("k").collect()] == [1.01, 2.34]
    sinks.write_table(d, str(tmp_path / "p"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("k = 'a'").count() == 1
    for v in ("v1", "v2"):
        sinks.log_run(sinks.run_record(d.select("n").limit(1), v, {"L": 8}), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).select("version").distinct().count() == 2
    assert durable(d).count() == 2


def test_features_of_one_quantity_are_tautologies(spark):
    same = [("thermal_load", "cooling_load"), ("delta_t", "delta_t_signed"), ("x_lag_1", "x_lag_2"), ("x", "x_lag_1"), ("x", "X_rolling_3h"), ("x_rate_of_change", "x"), ("x_lag_1", "x_rolling_24h"), ("thermal_load_lag_2", "cooling_load")]
    other = [("x", "y"), ("x_lag_1", "y_lag_1"), ("x", "x_squared"), ("x", "x"), ("flag_1", "flag_2")]
    got = spark.createDataFrame(same + other, "variable_1 string, variable_2 string").withColumn("t", correlate.tautology()).collect()
    assert [r.t for r in got] == [True] * len(same) + [False] * len(other)


def test_raw_names_are_cleaned_and_renamed(spark):
    d = spark.createDataFrame([("21.3 °C", "45 %")], ["Temp. Mandata", "Mod. V. Mandata"])
    got = clean.rename_signals(clean.clean_units(d, ["Temp. Mandata", "Mod. V. Mandata"])).first().asDict()
    assert got == {"Temperatura Mandata": 21.3, "Modulazione Ventilatore Mandata": 45.0}


def test_window_model_is_the_principal_subspace(spark):
    x = RNG.normal(size=(200, 4)) @ RNG.normal(size=(4, 6)) + RNG.normal(size=6)
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, window array<double>")
    for k in (2, 4):
        got = np.stack(anomaly.fit_reconstruction(d, k, 6).apply(d).orderBy("i").toPandas().rebuilt.to_numpy())
        m = x - x.mean(axis=0)
        v = np.linalg.svd(m, full_matrices=False)[2][:k]
        np.testing.assert_allclose(got, m @ v.T @ v + x.mean(axis=0), atol=1e-8)


def test_kendall_and_optimal_lag(spark):
    n = 120
    x = RNG.integers(0, 10, n).astype(float)
    pdf = pd.DataFrame({"k": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="30min"), "x": x, "y": np.roll(x, 3) + RNG.normal(scale=0.1, size=n)})
    d = spark.createDataFrame(pdf)
    r = correlate.optimal_lag(correlate.lag_correlation(d, S, "x", "y", 6, 0.5), ["k"]).first()
    assert r.optimal_lag_hours == 1.5 and r.optimal_r > 0.95
    t = correlate.kendall_pairs(d, ["k"], ["x", "y"]).first()
    a, b = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(pdf.y.to_numpy(), pdf.y.to_numpy()))
    np.testing.assert_allclose(t.r, (a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum()))


def _discordant(y):
    """Inversions by merge sort."""
    if len(y) < 2:
        return y, 0
    a, m = _discordant(y[: len(y) // 2])
    b, n = _discordant(y[len(y) // 2 :])
    return np.sort(np.concatenate([a, b]), kind="stable"), m + n + int((len(a) - np.searchsorted(a, b, side="right")).sum())


@pytest.mark.parametrize(("n", "bucket"), [(6000, 50), (100_000, 20_000)])
def test_kendall_of_many_rows_equals_a_merge_sort_count(spark, monkeypatch, n, bucket):
    from tidegrid.plans import ranks

    monkeypatch.setattr(ranks.with_less, "__defaults__", (bucket, ()))
    r = np.random.default_rng(1)
    x = r.integers(0, 3000, n).astype(float)
    y = np.round(x / 500 + r.normal(size=n), 2)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = correlate.kendall_pairs(d, [], ["x", "y"]).first()
    pairs = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True, axis=0)[1].astype(float))
    every, tx, ty, txy = n * (n - 1) / 2, pairs(x), pairs(y), pairs(np.column_stack([x, y]))
    worse = _discordant(y[np.lexsort((y, x))])[1]
    score = every - tx - ty + txy - 2 * worse
    assert got.n == n
    np.testing.assert_allclose(got.r, score / np.sqrt((every - tx) * (every - ty)), rtol=1e-12)


def test_density_of_few_pairs(spark):
    d = spark.range(4000).selectExpr("double(id % 100) x", "double(id) y")
    assert stats.density_grid(d, [], "x", "y").agg(F.sum("count")).first()[0] == 4000


def test_csv_by_header_name_position_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b, a \n1,x\nb, a \nsep=4,y\n\n3,\"two\nlines, \"\"q\"\"\"\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("sep=#\na#b\nñ#5\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("a;c;d;e\nü;1;2;3\n", encoding="utf-8")
    got = csv.read_export(spark, [str(tmp_path / f"{n}.csv") for n in "abc"], ["a", "b"]).collect()
    assert sorted(((r.a, r.b) for r in got), key=str) == sorted([("x", "1"), ("a", "b"), ("y", "sep=4"), ('two\nlines, "q"', "3"), ("ñ", "5"), ("ü", None)], key=str)


def test_holes_at_block_borders_are_found(spark, monkeypatch):
    """Rows of a table with holes and repeated stamps are reached by position, whatever the block length."""
    from tidegrid.plans import series

    pdf = grid(300, 0.1)
    pdf = pdf.drop(index=[*range(20, 27), *range(100, 104), *range(210, 260)]).reset_index(drop=True)
    t = pdf.ts
    back, ahead = t.diff() > pd.Timedelta(hours=2), (-t.diff(-1)) > pd.Timedelta(hours=2)
    for block in (7, 262_144):
        monkeypatch.setattr(series, "BLOCK_ROWS", block)
        monkeypatch.setattr(series.Series.block_micros, "__defaults__", (block,))
        d = put(spark, pdf)
        edges = collect(missing.boundary_rows(d.fillna(0.0, ["v"]), S, ["v"], 7200.0))
        assert (edges.is_boundary == (back | ahead)).all()
        q = {r.check: r.measured for r in missing.quality_checks(put(spark, pd.concat([pdf, pdf[5:6]])), S, {"v": (0, 99)}).collect()}
        assert q["time_gaps"] == back.sum() and q["duplicate_timestamps"] == 1
        np.testing.assert_allclose(collect(features.differences(d, S, {"d": "v"})).d, pdf.v.diff().fillna(0.0))
        np.testing.assert_allclose(collect(features.lags(d, S, ["v"], [3])).v_lag_3, pdf.v.shift(3))
        np.testing.assert_allclose(collect(features.rates(d, S, ["v"])).v_rate, pdf.v.diff())
        np.testing.assert_allclose(collect(clean.steps(d, S, "step"))["step"], t.diff().dt.total_seconds())


def test_last_of_repeated_stamps_counts_for_step_columns(spark):
    d = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1, 5.0), ("a", "2024-01-01 00:00:00", 2, 1.0), ("a", "2024-01-01 01:00:00", 3, 2.0)], "k string, t string, i int, sp double")
    s = Series(("k",), "ts", None, ("i",))
    got = grid_ops.role_resample(d.withColumn("ts", F.col("t").cast("timestamp_ntz")), s, 1800, ["sp"], ["sp"]).orderBy("ts").collect()
    assert [r.sp for r in got] == [1.0, 1.0, 2.0]


def test_one_value_repeated_millions_of_times(spark):
    d = spark.range(2_200_000).selectExpr("if(id % 2 = 0, 'a', 'b') g", "5.0D v")
    r = stats.compare_groups(d, [], "g", "a", "b", ["v"]).first()
    assert (r.n_a, r.n_b, r.ks_stat) == (1_100_000, 1_100_000, 0.0)


def test_small_groups_keep_their_row(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("b", 5.0)], "g string, v double")
    r = stats.compare_groups(d, [], "g", "a", "b", ["v"]).first()
    assert (r.n_a, r.n_b) == (1, 3) and r.t_p is r.u_p is r.ks_p is r.cohens_d is r.effect_size is None


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from tidegrid import session

    for master, fails in (("spark://a:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True), ("local[4]", False)):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
        if fails:
            with pytest.raises(RuntimeError):
                session.shared_folder(fake)
        else:
            session.shared_folder(fake)


def test_stages_are_removed(spark):
    import os

    from tidegrid import session

    session.remove_stages(spark)
    kept = session.durable(spark.range(3))
    path = kept.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path) and session.remove_stages(spark) == 1 and not os.path.exists(os.path.dirname(path))


def test_constant_and_empty_columns_do_not_fail(spark):
    """ANSI mode raises on division by zero: constant, all-NULL and single-row inputs give NULLs."""
    pdf = grid(200, 0.0).assign(v=5.0, w=0.0)
    d = put(spark, pdf).withColumns({"none": F.lit(None).cast("double"), "season": F.when(F.dayofmonth("ts") < 3, "a").otherwise("b")})
    cols = ["v", "w", "none"]
    frames = [
        stats.describe(d, ["k"], cols), stats.anderson_darling(d, ["k"], cols), stats.kpi_board(d, ["k"], "season", cols),
        stats.histogram(d, ["k"], cols), stats.kde(d, ["k"], ["v"]), stats.compare_groups(d, ["k"], "season", "a", "b", ["v", "w"]),
        stats.pair_metrics(d, ["k"], {"p": ("v", "none", 1.0), "q": ("v", "w", 1.0)}), stats.density_grid(d, ["k"], "v", "w"),
        profiles.weekly_kpis(d, S, cols), profiles.season_profiles(d, S, "season", cols), profiles.monthly_curves(d, S, "none"),
        outlier.statistical_counts(d, ["k"], ["v", "w"]), outlier.outlier_summary(outlier.flag_table(d, S, {"none": outlier.Rules(limits=(0, 1)), "v": outlier.Rules(spike_k=3.0, stuck_rows=5)}), ["k"]),
        correlate.p_values(correlate.pearson_pairs(d, ["k"], cols)), correlate.p_values(correlate.spearman_pairs(d, ["k"], ["v", "w"])),
        sequence.scaled_variance(d, sequence.fit_scaler(d, ["k"], ["v", "w"]), ["k"], ["v", "w"]), anomaly.quality(d, ["k"], {"v": ("v", "w")}),
        missing.quality_checks(d, S, {"v": (0, 1), "none": (0, 1)}),
    ]
    for f in frames:
        f.collect()
    kept = sequence.scaled_variance(d, sequence.fit_scaler(d, ["k"], ["v"]), ["k"], ["v"]).first()
    assert kept.scaled_variance is None and kept.keep is False


def csv_brute(text, sep, most):
    """Records as lists of trimmed fields, by a reader that goes through the text once; a quote opens only where a field begins."""
    lines, out, at = text.split("\n"), [], 0

    def ends_inside(line, inside):
        begins, k = not inside, 0
        while k < len(line):
            c = line[k]
            if inside and c == '"':
                if line[k + 1 : k + 2] == '"':
                    k += 1
                else:
                    inside = False
            elif not inside and begins and c == '"':
                inside = True
            begins = not inside and c == sep
            k += 1
        return inside

    while at < len(lines):
        inside, n = ends_inside(lines[at], False), 1
        while inside and n < most and at + n < len(lines):
            inside, n = ends_inside(lines[at + n], True), n + 1
        n = 1 if inside else n
        record, fields, k = "\n".join(lines[at : at + n]), [], 0
        while k <= len(record):
            field = ""
            if record[k : k + 1] == '"':
                found = re.match(r'"((?:[^"]|"")*+)"', record[k:])
                if found:
                    field, k = found[1].replace('""', '"'), k + found.end()
            end = record.find(sep, k)
            end = len(record) if end < 0 else end
            fields.append((field + record[k:end]).strip(" "))
            k = end + 1
        if record.strip(" "):
            out.append((tuple(fields), inside))
        at += n
    return out


def test_a_stray_quote_loses_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,pipe 5" long\n2,y\n3,z\n4,w\n')
    (tmp_path / "b.csv").write_text('a,b\n1,"never closed\n2,y\n3,z\n4,"x\ny"\n5,"p ""q"" r"s\n6, "t\n7,""\n')
    for most in (1000, 2):
        records, dialects = csv.read_records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], most)
        got = {(r.file[-5], r.a): r.b for r in csv.parse(records, dialects, ["a", "b"]).collect()}
        assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"1": 'pipe 5" long', "2": "y", "3": "z", "4": "w"}
        if most == 2:
            assert {k[1]: v for k, v in got.items() if k[0] == "b"} == {"1": '"never closed', "2": "y", "3": "z", "4": "x\ny", "5": 'p "q" rs', "6": '"t', "7": None}
            assert [r.value for r in csv.unclosed_quotes(records).collect()] == ['1,"never closed']


@pytest.mark.parametrize("split", [None, 700])
def test_records_equal_a_sequential_reader(spark, tmp_path, split):
    """Files of random quotes, separators and line ends, whole and in many splits."""
    rng = np.random.default_rng(21)
    texts = {}
    for k in range(6):
        body = "".join(rng.choice(list('ab",,\n "') + ['""', '"\n'], 400 + 200 * k))
        texts[f"f{k}"] = "a,b,c\na,b,c\na,b,c\na,b,c\na,b,c\n" + body.replace("\r", "")
        (tmp_path / f"f{k}.csv").write_text(texts[f"f{k}"], newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for most in (3,) if split else (3, 1000):
            records, dialects = csv.read_records(spark, str(tmp_path), most)
            d = records.join(dialects.select("file", "sep"), "file")
            got = {}
            for r in d.select("file", "pos", "unclosed", csv._fields(F.col("value"), F.col("sep")).alias("f"), F.trim("value").alias("v")).orderBy("file", "pos").collect():
                if r.v:
                    got.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append((tuple(r.f), r.unclosed))
            for name, text in texts.items():
                assert got[name] == csv_brute(text.removesuffix("\n"), ",", most), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_quoted_fields_do_not_overflow(spark, tmp_path):
    text = "x" * 200000 + '""' * 100000
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{text}"\n2,{text}\n')
    got = {r.a: r.b for r in csv.read_export(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()}
    assert got == {"1": text.replace('""', '"'), "2": text}


def test_sinks_are_whole_and_repeatable(spark, tmp_path):
    path, runs = str(tmp_path / "t"), str(tmp_path / "runs")
    d = spark.createDataFrame([(1, 1.234), (2, 2.5)], "n int, v double")
    sinks.write_table(d, path)
    broken = d.withColumn("v", F.when(F.col("n") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(broken, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1.234), (2, 2.5)]
    sinks.write_table(d.limit(1), path, digits=1)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, 1.2)]
    record = lambda rows, v: sinks.run_record(rows, v, {"L": 8})
    for version in ("01", "1", "01"):
        sinks.log_run(record(d, version), runs)
    with pytest.raises(Exception, match="lost"):
        sinks.log_run(record(broken, "2"), runs)
    sinks.log_run(record(d, "2"), runs)
    got = sinks.read_runs(spark, runs)
    assert sorted((r.version, r.n) for r in got.collect()) == [(v, n) for v in ("01", "1", "2") for n in (1, 2)]
    assert set(got.columns) == {"version", "config", "n", "v", "logged_at"}


def test_density_equals_the_exact_sum(spark):
    """Cells and moments against the sum over all values, with ties, a far value, and columns without a bandwidth."""
    rng = np.random.default_rng(31)
    v = np.concatenate([rng.normal(size=3000), rng.exponential(3, 2000), np.repeat(1.5, 300), [40.0]])
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v, "w": 2.0}))
    got = stats.kde(d, ["k"], ["v"]).orderBy("point").toPandas()
    h = v.std(ddof=1) * len(v) ** -0.2
    exact = np.exp(-((got.x.to_numpy()[:, None] - v) ** 2) / (2 * h * h)).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got.density, exact, rtol=1e-9, atol=1e-15)
    assert stats.kde(d, ["k"], ["w"]).filter("density IS NOT NULL").count() == 0


def test_setpoint_of_a_season():
    names = ["Set Point Mandata", "setpoint heating", "Set Points Compensata", "T Raffreddamento"]
    assert features.season_setpoint("summer", names) is None
    assert features.season_setpoint("Summer", [*names, "Setpoint Raffreddamento"]) == "Setpoint Raffreddamento"
    assert [features.season_setpoint("winter", names[:n]) for n in (3, 2, 1, 0)] == ["Set Points Compensata", "setpoint heating", "Set Point Mandata", None]
    assert features.season_setpoint("winter", ["Setpoint X"]) == "Setpoint X" and features.season_setpoint("spring", names) is None


def test_missing_setpoint_gives_no_error(spark):
    assert features.setpoint_error(spark.range(2).withColumn("m", F.lit(20.0)), "m", None).filter("setpoint_error IS NULL").count() == 2
