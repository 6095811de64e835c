"""Chronological-split regression on Spark ML, and the search over window models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.columns import ratio
from tidegrid.operators.anomaly import fit_reconstruction, window_score
from tidegrid.operators.sequence import fit_scaler, scale, sliding_windows
from tidegrid.plans.blocks import positions
from tidegrid.plans.series import Series, attach
from tidegrid.session import durable

# Split shares, over-fit bounds on the R2 drop from train to test, search space.
TRAIN, VALIDATION = 0.70, 0.15
OVERFIT = ((0.15, "high"), (0.08, "moderate"))
LENGTHS, BOTTLENECKS = (8, 16, 24, 48), (8, 16, 32)


def select_complete(df: DataFrame, s: Series, features: Sequence[str], target: str) -> DataFrame:
    missing = [c for c in (*features, target) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*s.keys, s.ts, *features, target).dropna(subset=[*features, target])


def split_rows(df: DataFrame, s: Series, train: float = TRAIN, validation: float = VALIDATION, out: str = "split") -> DataFrame:
    """Chronological split by row number: ``int(n * train)`` rows, then ``int(n * validation)``, then the rest."""
    n = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("__n"))
    d = attach(positions(df, s, "__i"), n, s.keys)
    a = F.floor(F.col("__n") * train)
    b = a + F.floor(F.col("__n") * validation)
    label = F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "val").otherwise("test")
    return d.withColumn(out, label).drop("__i", "__n")


def standardise(df: DataFrame, keys: Sequence[str], features: Sequence[str], split: str = "split") -> DataFrame:
    """Zero mean and unit population deviation, fitted on the training rows."""
    params = fit_scaler(df.filter(F.col(split) == "train"), keys, features, "standard")
    return scale(df, params, keys, features)


def models(trees: int = 100, forest_depth: int = 15, leaf: int = 5, rounds: int = 100, boost_depth: int = 6, rate: float = 0.1, subsample: float = 0.8, seed: int = 42, bootstrap: bool = True) -> dict:
    common = {"featuresCol": "x", "labelCol": "y"}
    return {
        "linear": LinearRegression(**common, regParam=0.0),
        "forest": RandomForestRegressor(**common, numTrees=trees, maxDepth=forest_depth, minInstancesPerNode=leaf, seed=seed, bootstrap=bootstrap),
        "boosting": GBTRegressor(**common, maxIter=rounds, maxDepth=boost_depth, stepSize=rate, subsamplingRate=subsample, seed=seed),
    }


def assemble(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="x").transform(df).withColumn("y", F.col(target).cast("double"))


def fit_all(df: DataFrame, features: Sequence[str], target: str, estimators: dict | None = None, split: str = "split") -> tuple[dict, DataFrame]:
    """Fitted models and the long prediction table ``model, split, y, prediction`` with the other columns."""
    d = durable(assemble(df, features, target))
    fitted = {n: e.fit(d.filter(F.col(split) == "train")) for n, e in (estimators or models()).items()}
    out = None
    for n, m in fitted.items():
        p = m.transform(d).withColumn("model", F.lit(n)).drop("x")
        out = p if out is None else out.unionByName(p)
    return fitted, out


def evaluate(predictions: DataFrame, split: str = "split") -> DataFrame:
    """RMSE, MAE and R2 per model and split."""
    e = F.col("y") - F.col("prediction")
    return predictions.groupBy("model", split).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - ratio(F.avg(e * e), F.var_pop("y"))).alias("r2"))


def compare(metrics: DataFrame, split: str = "split") -> DataFrame:
    """One row per model with its figures by split and the over-fit label."""
    pick = lambda s, m: F.max(F.when(F.col(split) == s, F.col(m))).alias(f"{s}_{m}")
    d = metrics.groupBy("model").agg(*[pick(s, m) for s in ("train", "val", "test") for m in ("rmse", "mae", "r2")])
    drop = F.col("train_r2") - F.col("test_r2")
    label = F
    for bound, name in OVERFIT:
        label = label.when(drop > bound, name)
    return d.withColumns({"r2_drop": drop, "overfit": label.otherwise("low")})


def with_residuals(predictions: DataFrame) -> DataFrame:
    r = F.col("y") - F.col("prediction")
    return predictions.withColumns({"residual": r, "abs_residual": F.abs(r)})


def importances(fitted: dict, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Tree importance per model, ranked."""
    rows = []
    for n, m in fitted.items():
        if hasattr(m, "featureImportances"):
            vals = sorted(((float(m.featureImportances[i]), f) for i, f in enumerate(features)), key=lambda t: (-t[0], t[1]))
            rows += [(n, f, v, r) for r, (v, f) in enumerate(vals, 1)]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, importance double, rank int")


def search(df: DataFrame, s: Series, columns: Sequence[str], step_s: int, lengths: Sequence[int] = LENGTHS, sizes: Sequence[int] = BOTTLENECKS, split: str = "split") -> DataFrame:
    """Validation error of the linear autoencoder over window lengths and bottlenecks, best first.

    Windows are prepared once per length and fitted once for the largest bottleneck: the directions of a smaller one are its
    first. A bottleneck must be smaller than the window; a length without training windows has NULL errors.
    """
    ks = Series((*s.keys, split), s.ts, s.step, s.tie, s.span)
    rows = None
    for n in lengths:
        size = n * len(columns)
        windows = durable(sliding_windows(df, ks, columns, n, step_s))
        train, val = windows.filter(F.col(split) == "train"), windows.filter(F.col(split) == "val")
        own = sorted(k for k in sizes if k < size)
        model = fit_reconstruction(train, own[-1], size) if own else None
        for k in own:
            scored = val.withColumn("rebuilt", F.lit(None).cast("array<double>")) if model is None else model.first(k).apply(val)
            scored = scored.withColumn("score", window_score("window", "rebuilt"))
            r = scored.groupBy().agg(F.avg("score").alias("val_mae"), F.count(F.lit(1)).alias("n_windows"))
            r = r.select(F.lit(n).alias("length"), F.lit(k).alias("bottleneck"), "val_mae", "n_windows")
            rows = r if rows is None else rows.unionByName(r)
    return rows.orderBy(F.col("val_mae").asc_nulls_last(), "length", "bottleneck")
