"""Core plans against pandas / NumPy, with block sizes small enough to cross borders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.plans import blocks, quantiles, ranks
from tidegrid.plans.series import Series

RNG = np.random.default_rng(7)


def frame(n=400, regular=True):
    gaps = np.full(n, 1800) if regular else RNG.integers(1, 90_000, n)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps), unit="s")
    pdf = pd.DataFrame({"k": np.where(np.arange(n) % 3 == 0, "a", "b"), "ts": ts, "v": RNG.normal(size=n).round(2)})
    if regular:
        pdf["k"] = "a"
    return pdf


@pytest.mark.parametrize("regular", [True, False])
@pytest.mark.parametrize("rows", [7, 1000])
def test_rolling_matches_pandas(spark, regular, rows):
    pdf = frame(regular=regular)
    s = Series(("k",), "ts", 1800 if regular else None)
    got = blocks.rolling(
        spark.createDataFrame(pdf), s, 9, 2,
        lambda w: {"m": F.avg("v").over(w.rowsBetween(-9, 0)), "nx": F.lead("v", 2).over(w)}, rows=rows,
    ).toPandas().sort_values(["k", "ts"])
    exp = pdf.sort_values(["k", "ts"])
    m = exp.groupby("k").v.rolling(10, min_periods=1).mean().to_numpy()
    np.testing.assert_allclose(got.m, m, atol=1e-12)
    np.testing.assert_allclose(got.nx, exp.groupby("k").v.shift(-2))


@pytest.mark.parametrize("regular", [True, False])
def test_running_and_positions(spark, regular):
    pdf = frame(regular=regular)
    s = Series(("k",), "ts", None, span=86_400)
    got = blocks.running(blocks.positions(spark.createDataFrame(pdf), s), s, {"c": ("sum", F.col("v"))})
    back = blocks.running(got, s, {}, {"r": ("count", F.when(F.col("v") > 0, 1))})
    got = back.toPandas().sort_values(["k", "ts"])
    exp = pdf.sort_values(["k", "ts"])
    np.testing.assert_allclose(got.c, exp.groupby("k").v.cumsum(), atol=1e-9)
    np.testing.assert_array_equal(got.pos, exp.groupby("k").cumcount())
    pos = exp.assign(p=(exp.v > 0).astype(int))[::-1].groupby("k").p.cumsum()[::-1]
    np.testing.assert_array_equal(got.r, pos)


@pytest.mark.parametrize("regular", [True, False])
def test_runs(spark, regular):
    pdf = frame(regular=regular)
    s = Series(("k",), "ts", 1800 if regular else None)
    sdf = spark.createDataFrame(pdf)
    ep = blocks.episodes(sdf, s, F.col("v") > -0.8).toPandas().sort_values(["k", "start_time"])
    exp = pdf.sort_values(["k", "ts"])
    exp["f"] = exp.v > -0.8
    exp["run"] = exp.groupby("k").f.transform(lambda x: (x != x.shift()).cumsum())
    e = exp[exp.f].groupby(["k", "run"]).ts.agg(["min", "max", "count"]).reset_index()
    np.testing.assert_array_equal(ep.start_time, e["min"])
    np.testing.assert_array_equal(ep.end_time, e["max"])
    np.testing.assert_array_equal(ep.n_rows, e["count"])
    n = 4
    kept = blocks.rolling(sdf, s, n - 1, n - 1, *blocks.run_stages(s, {"p": (F.col("v") > -0.8, n)}), rows=5)
    kept = kept.toPandas().sort_values(["k", "ts"])
    size = exp.groupby(["k", "run"]).f.transform("size")
    np.testing.assert_array_equal(kept.p, exp.f & (size >= n))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_exact_quantiles(spark, keys, accuracy):
    n = 5000
    pdf = pd.DataFrame({
        "k": np.where(RNG.random(n) < 0.7, "hot", "cold"),
        "value": np.where(RNG.random(n) < 0.3, 0.0, np.exp(RNG.normal(size=n) * 3)),
    })
    pdf.loc[::17, "value"] = None
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = quantiles.long_quantiles(spark.createDataFrame(pdf), keys, probs, accuracy).toPandas()
    groups = pdf.groupby("k") if keys else [(None, pdf)]
    for key, g in groups:
        row = got[got.k == key].iloc[0] if keys else got.iloc[0]
        np.testing.assert_allclose(row.q, np.quantile(g.value.dropna(), probs), rtol=1e-12)


def test_small_groups_quantiles(spark):
    rows = [(i, float(j * j)) for i in range(1, 30) for j in range(i)]
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = quantiles.long_quantiles(spark.createDataFrame(rows, "k int, value double"), ["k"], probs).collect()
    for r in got:
        np.testing.assert_allclose(r.q, np.quantile([float(j * j) for j in range(r.k)], probs))


@pytest.mark.parametrize("keys", [["k"], []])
def test_average_ranks(spark, keys):
    n = 3000
    pdf = pd.DataFrame({"k": RNG.choice(["a", "b"], n), "v": RNG.normal(size=n).round(2)})
    got = ranks.average_ranks(spark.createDataFrame(pdf), keys, "v").toPandas()
    pdf["r"] = pdf.groupby("k").v.rank() if keys else pdf.v.rank()
    m = pdf.merge(got, on=[*keys, "v"])
    assert len(m) == n
    np.testing.assert_allclose(m.r, m["rank"])


def test_ranks_over_many_buckets(spark):
    """A group of most rows is cut by value like any other; each row finds its bucket among many."""
    d = spark.range(40_000).selectExpr("id % 10 < 1 AS g", "cast((id * 7919) % 20011 AS double) AS v").withColumn("g", F.col("g").cast("int"))
    got = ranks.with_less(ranks.value_counts(d, ["g"], "v"), ["g"], "v", rows=100).toPandas()
    pdf = d.toPandas()
    for g, part in pdf.groupby("g"):
        own = got[got.g == g].sort_values("v")
        sizes = part.groupby("v").size()
        assert list(own.v) == list(sizes.index) and list(own.n) == list(sizes)
        assert list(own.less) == list(sizes.cumsum() - sizes) and (own.total == len(part)).all()


def test_quantiles_count_a_row_once(spark):
    """Many overlapping ranks, ties and tiny groups against numpy; the counting step copies no row."""
    rng = np.random.default_rng(41)
    pdf = pd.DataFrame({"g": rng.choice(5, 6000, p=[0.6, 0.2, 0.1, 0.0995, 0.0005]), "value": np.round(rng.normal(size=6000), 2)})
    probs = [0, 0.01, 0.05, 0.25, 0.5, 0.5001, 0.75, 0.95, 0.99, 1]
    got = quantiles.long_quantiles(spark.createDataFrame(pdf), ["g"], probs)
    for r in got.collect():
        own = pdf[pdf.g == r.g].value
        assert r.n == len(own)
        np.testing.assert_allclose(r.q, np.quantile(own, probs), rtol=1e-12, atol=1e-12)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
