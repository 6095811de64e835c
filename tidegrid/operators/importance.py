"""Feature quality, relevance and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import roles
from tidegrid.operators.correlate import p_values, spearman_pairs
from tidegrid.operators.impute import median_impute
from tidegrid.plans.quantiles import exact_quantiles, melt
from tidegrid.plans.series import attach
from tidegrid.session import durable

# Weights and bounds of the composite score, rows above which a rank correlation is told.
WEIGHTS = {"max_abs_corr": 0.3, "mutual_info": 0.35, "rf_importance": 0.35}
KEEP_ABOVE, CONSIDER_ABOVE, TOO_MISSING, NO_VARIANCE = 0.5, 0.2, 50.0, 1e-10
MIN_ROWS = 10


def category(name: str = "feature") -> Column:
    """Feature group by the ordered keyword rules; NULL when no rule applies."""
    low = F.lower(name)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    out = F.when(~has(roles.DERIVED_WORDS), "Original Measurements")
    for label, words, without in roles.CATEGORY_RULES:
        out = out.when(has(words) & ~has(without) if without else has(words), label)
    return out


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = melt(df, [], columns).withColumnRenamed("variable", "feature").groupBy("feature").agg(
        (100.0 * F.avg(F.isnull("value").cast("int"))).alias("missing_pct"), F.var_samp("value").alias("variance"),
        F.stddev_samp("value").alias("std"), F.avg("value").alias("mean"))
    return d.withColumn("cv", F.when(F.col("mean") != 0, 100.0 * F.col("std") / F.col("mean")).otherwise(0.0))


def target_correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Rank correlation with its p value for every feature and target; NULL for pairs of ten rows and fewer."""
    d = spearman_pairs(df, [], [], [(f, t) for f in features for t in targets])
    d = p_values(d.withColumn("r", F.when(F.col("n") > MIN_ROWS, F.col("r"))))
    d = d.withColumn("p_value", F.when(F.col("n") > MIN_ROWS, F.col("p_value")))
    return d.select(F.col("variable_1").alias("feature"), F.col("variable_2").alias("target"), "r", "p_value", "n")


def best_target(corr: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Largest absolute coefficient and its target, the earlier target on ties."""
    order = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("target"))
    best = F.max_by("target", F.struct(F.abs("r"), -order))
    return corr.filter("r IS NOT NULL").groupBy("feature").agg(F.max(F.abs("r")).alias("max_abs_corr"), best.alias("best_target"))


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of quantile-binned features with the binned target, on complete rows."""
    cols = [*features, target]
    probs = [i / bins for i in range(1, bins)]
    d = df.select(*cols).dropna()
    q = exact_quantiles(d, [], cols, probs)
    # one row of bin edges
    edges = q.groupBy().agg(*[F.max(F.when(F.col("variable") == c, F.col("q"))).alias(f"__q_{c}") for c in cols])
    d = attach(d, edges, [])
    below = lambda c: F.size(F.filter(f"__q_{c}", lambda e: e < F.col(c)))
    d = d.select(*[below(c).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.col(target).alias("y")) for f in features])
    joint = durable(d.select(F.explode(cells).alias("c")).select("c.*").groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    # at most bins x bins rows per feature from here on
    px = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    tot = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    j = joint.join(px, ["feature", "x"]).join(py, ["feature", "y"]).join(tot, "feature")
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def forest_importance(df: DataFrame, features: Sequence[str], target: str, trees: int = 100, depth: int = 10, seed: int = 42, bootstrap: bool = True) -> DataFrame:
    """Random-forest importance after median imputation; without ``bootstrap`` every tree learns from every row."""
    d = median_impute(df.dropna(subset=[target]), [], features)
    x = VectorAssembler(inputCols=list(features), outputCol="x").transform(d).select("x", F.col(target).alias("y"))
    model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, bootstrap=bootstrap).fit(x)
    imp = model.featureImportances
    rows = [(f, float(imp[i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, rf_importance double")


def assemble(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Left-join per-feature tables (one row per column of the data) on ``feature``."""
    for o in others:
        first = first.join(o, "feature", "left")
    return durable(first)


def composite(report: DataFrame) -> DataFrame:
    """Score and recommendation from missing share, variance and the available relevance measures."""
    score = F.lit(0.0)
    if "mutual_info" in report.columns:
        top = report.groupBy().agg(F.max("mutual_info")).scalar()
        report = report.withColumn("__mi", F.when(top > 0, F.coalesce("mutual_info", F.lit(0.0)) / top).otherwise(0.0))
    for c, w in WEIGHTS.items():
        if c in report.columns:
            part = F.col("__mi") if c == "mutual_info" else F.coalesce(c, F.lit(0.0))
            score = score + part * w
    d = report.withColumn("composite_score", score).drop("__mi")
    rec = (
        F.when(F.col("missing_pct") > TOO_MISSING, "REMOVE - High Missing Data")
        .when(F.col("variance") < NO_VARIANCE, "REMOVE - No Variation")
        .when(F.col("composite_score") > KEEP_ABOVE, "KEEP - High Importance")
        .when(F.col("composite_score") > CONSIDER_ABOVE, "CONSIDER - Medium Importance")
        .otherwise("REMOVE - Low Importance")
    )
    return d.withColumn("recommendation", rec)


def selected(report: DataFrame, include_consider: bool = True) -> DataFrame:
    keep = F.col("recommendation").startswith("KEEP")
    if include_consider:
        keep = keep | F.col("recommendation").startswith("CONSIDER")
    return report.filter(keep).select("feature", "composite_score", "recommendation")


def recommendation_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"))
