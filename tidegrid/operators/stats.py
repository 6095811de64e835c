"""Descriptive statistics, distribution tests, pair metrics and season comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import factorial, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.columns import as_col, correlation, false_if_null, ladder, ladder_above, ratio
from tidegrid.functions.special import kolmogorov_sf, log_normal_cdf, normal_cdf, t_two_sided
from tidegrid.plans.quantiles import VALUE, VARIABLE, long_quantiles, melt
from tidegrid.plans.ranks import value_counts, with_less
from tidegrid.plans.series import attach
from tidegrid.session import durable

# Variability bounds, outlier severity, Anderson-Darling 5 % constant, effect sizes.
CV_LABELS = ((5, "very stable"), (15, "moderate variability"))
OUTLIER_LABELS = ((1, "Low"), (5, "Moderate"))
AD_FIVE_PERCENT = 0.787
EFFECTS = ((0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium"))
ALPHA = 0.05
MIN_DAYS = 3


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key and column: counts, moments, quantiles, skewness and excess kurtosis."""
    by = [*keys, VARIABLE]
    long = melt(df, keys, columns)
    m = long.groupBy(*by).agg(
        F.count(VALUE).alias("count"), (100.0 * F.count(VALUE) / F.count(F.lit(1))).alias("valid_pct"), F.avg(VALUE).alias("mean"),
        F.stddev_samp(VALUE).alias("std"), F.var_samp(VALUE).alias("variance"), F.min(VALUE).alias("min"), F.max(VALUE).alias("max"),
        F.skewness(VALUE).alias("skewness"), F.kurtosis(VALUE).alias("kurtosis"),
    )
    q = long_quantiles(long, by, [0.05, 0.25, 0.5, 0.75, 0.95])
    names = ("p5", "q1", "median", "q3", "p95")
    d = m.join(q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)]), by, "left")
    return d.withColumns({
        "cv_pct": F.when(F.col("mean") != 0, 100.0 * F.col("std") / F.col("mean")),
        "range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1"),
    })


def jarque_bera(stats: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Add the statistic from skewness and kurtosis, its p value and the verdict."""
    jb = F.col("count") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    d = stats.withColumn("jb_stat", jb).withColumn("jb_p", F.exp(-F.col("jb_stat") / 2))
    return d.withColumn("jb_normal", F.col("jb_p") > alpha)


def anderson_darling(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Normality statistic against its 5 % critical value, over distinct values with their ranks."""
    by = [*keys, VARIABLE]
    long = melt(df, keys, columns)
    m = long.groupBy(*by).agg(F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("sd"))
    d = with_less(value_counts(long, by, VALUE), by, VALUE).join(m, by)
    z, n, less, total = ratio(F.col(VALUE) - F.col("mean"), F.col("sd")), F.col("n"), F.col("less"), F.col("total")
    # doubles, for squares of ranks pass the range of a long
    n, less, total = n.cast("double"), less.cast("double"), total.cast("double")
    upto = less + n
    # sums of (2i - 1) and of (2 (N - i) + 1) over the ranks a value holds
    low = upto * upto - less * less
    high = n * (2 * total + 1) - (upto * (upto + 1) - less * (less + 1))
    term = low * log_normal_cdf(z) + high * log_normal_cdf(-z)
    out = d.groupBy(*by).agg(F.first("total").alias("n"), F.sum(term).alias("__s"))
    crit = AD_FIVE_PERCENT / (1 + 4 / F.col("n") - 25 / F.col("n") / F.col("n"))
    out = out.withColumns({"ad_stat": -F.col("n") - F.col("__s") / F.col("n"), "ad_critical": F.round(crit, 3)}).drop("__s")
    return out.withColumn("ad_normal", F.col("ad_stat") < F.col("ad_critical"))


def interpret(stats: DataFrame, cv: str = "cv_pct", jb: str = "jb_normal", ad: str = "ad_normal", outliers: str = "iqr_pct") -> DataFrame:
    """Labels for variability, distribution and outlier share."""
    both, one = F.col(jb) & F.col(ad), F.col(jb) | F.col(ad)
    return stats.withColumns({
        "cv_label": ladder(F.col(cv), CV_LABELS, "high variability"),
        "distribution": F.when(both, "Normal").when(one, "Likely Normal").otherwise("Non-Normal"),
        "outlier_severity": ladder(F.col(outliers), OUTLIER_LABELS, "High"),
    })


def histogram(df: DataFrame, keys: Sequence[str], columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; empty bins are left out."""
    by = [*keys, VARIABLE]
    long = melt(df, keys, columns).filter(F.col(VALUE).isNotNull())
    ext = long.groupBy(*by).agg(F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(VALUE) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    d = long.join(ext, by).groupBy(*by, "lo", "hi", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return d.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_from"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_to"), "count")


#: Moments of a cell of half a bandwidth: what the expansion leaves out is below 1e-16 of a kernel's height.
MOMENTS = 16


def kde(df: DataFrame, keys: Sequence[str], columns: Sequence[str], points: int = 200, bins: int = 50) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid, also scaled to histogram counts.

    Values are gathered in cells of half a bandwidth, each kept as its moments about the middle. With u the distance of a
    point from the middle and t that of a value, both in bandwidths, exp(-(u - t)^2 / 2) is exp(-u^2 / 2) times the sum of
    He_k(u) t^k / k!, He being Hermite polynomials; so a cell adds all of its kernels at once. Only cells meet the points,
    and their number does not grow with that of distinct values. The terms left out are below 1.1 * 4^-16 / sqrt(16!)
    of a kernel's height.
    """
    by = [*keys, VARIABLE]
    long = melt(df, keys, columns).filter(F.col(VALUE).isNotNull())
    st = durable(long.groupBy(*by).agg(F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"), F.stddev_samp(VALUE).alias("sd"), F.count(F.lit(1)).alias("total")))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
    cell = F.when(F.col("h") > 0, F.floor((F.col(VALUE) - F.col("lo")) / (F.col("h") / 2))).otherwise(F.lit(0))
    middle = F.col("lo") + (F.col("cell") + 0.5) * F.col("h") / 2
    d = long.join(st, by).withColumn("cell", cell).withColumn("t", ratio(F.col(VALUE) - middle, F.col("h")))
    d = d.groupBy(*by, "lo", "hi", "h", "total", "cell").agg(F.array(*[F.sum(F.pow("t", F.lit(float(k)))) / float(factorial(k)) for k in range(MOMENTS)]).alias("m"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    d = d.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    d = d.withColumn("u", ratio(F.col("lo") + F.col("point") * step - middle, F.col("h")))
    # He_0 = 1, He_k+1 = u He_k - k He_k-1
    state = lambda k, last, own, total: F.struct(k.alias("k"), last.alias("last"), own.alias("own"), total.alias("total"))
    zero = F.lit(0.0)
    series = F.aggregate(
        "m", state(zero, zero, F.lit(1.0), zero),
        lambda s, m: state(s["k"] + 1, s["own"], F.col("u") * s["own"] - s["k"] * s["last"], s["total"] + m * s["own"]),
        lambda s: s["total"],
    )
    kernel = ratio(F.exp(-F.col("u") * F.col("u") / 2) * series, F.col("total") * F.col("h") * sqrt(2 * pi))
    d = d.groupBy(*by, "point", "lo", "hi", "total").agg(F.sum(kernel).alias("density"))
    scaled = F.col("density") * F.col("total") * (F.col("hi") - F.col("lo")) / bins
    return d.select(*by, "point", (F.col("lo") + F.col("point") * step).alias("x"), "density", scaled.alias("scaled"))


def pair_metrics(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[Column | str, Column | str, float]]) -> DataFrame:
    """Per named pair ``(x, y, threshold)``: n, correlation, and against ``y = x`` RMSE, MAE, extremes and share within."""
    cells = []
    for name, (x, y, limit) in pairs.items():
        x, y = as_col(x).cast("double"), as_col(y).cast("double")
        e = y - x
        n = F.count(e)
        cells.append(F.struct(
            F.lit(name).alias("pair"), n.alias("n"), correlation(x, y).alias("r"), F.avg(e).alias("mean_diff"), F.stddev_samp(e).alias("std_diff"),
            F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_abs"),
            ratio(100.0 * F.count_if(F.abs(e) <= limit), n).alias("within_pct"),
        ).alias(f"__{len(cells)}"))
    g = df.groupBy(*keys).agg(*cells)
    return g.select(*keys, F.explode(F.array(*[F.col(f"__{i}") for i in range(len(cells))])).alias("p")).select(*keys, "p.*")


def density_grid(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts of complete pairs on a ``bins`` x ``bins`` grid between the extremes of each key."""
    d = df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).dropna(subset=["x", "y"])
    ext = d.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    d = attach(d, ext, list(keys))
    cell = lambda v, a, b: F.coalesce(F.least(F.floor(ratio(F.col(v) - F.col(a), (F.col(b) - F.col(a)) / bins)), F.lit(bins - 1)), F.lit(0))
    return d.groupBy(*keys, cell("x", "x0", "x1").alias("x_bin"), cell("y", "y0", "y1").alias("y_bin")).agg(F.count(F.lit(1)).alias("count"))


def assess_pairs(metrics: DataFrame) -> DataFrame:
    """Verdicts on tracking, relationship, outdoor influence, coordination, effort and sensor sign."""
    r, a = F.col("r"), F.abs("r")
    return metrics.withColumns({
        "tracking": ladder_above(F.col("within_pct"), ((85, "excellent"), (70, "good"), (50, "moderate issues")), "control problems"),
        "relationship": ladder_above(r, ((0.85, "strong"), (0.6, "moderate")), "weak"),
        "influence": ladder_above(a, ((0.7, "strong"), (0.4, "moderate")), "weak"),
        "effort": F.when(a > 0.5, "clear").otherwise("weak"),
        "inverse_check": F.when(r < -0.3, "inverse as expected").when(r > 0.3, "unexpected positive").otherwise("weak"),
    })


def load_duration(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Descending load curve as steps: each distinct value with the share of time it begins and ends at.

    The step form holds every row (``n`` of them per value) without numbering
    rows one by one, so a value repeated by most rows costs nothing.
    """
    d = with_less(value_counts(df.select(*keys, F.col(column).alias(VALUE)), keys, VALUE), keys, VALUE)
    above = F.col("total") - F.col("less") - F.col("n")
    span = F.greatest(F.col("total") - 1, F.lit(1))
    return d.select(*keys, VALUE, "n", (100.0 * above / span).alias("pct_from"), (100.0 * (above + F.col("n") - 1) / span).alias("pct_to"))


def season_stats(df: DataFrame, keys: Sequence[str], season: str, columns: Sequence[str]) -> DataFrame:
    d = describe(df, [*keys, season], columns)
    return d.select(*keys, season, VARIABLE, "count", "mean", "median", "std", "min", "max", "q1", "q3", "cv_pct")


def compare_groups(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, columns: Sequence[str], alpha: float = ALPHA, min_n: int = MIN_DAYS) -> DataFrame:
    """Welch t, Mann-Whitney U, Kolmogorov-Smirnov and Cohen's d between two groups of rows (daily means).

    U and KS p values are the tie-corrected normal and the asymptotic ones. A group with fewer than ``min_n`` rows on a side
    keeps its row, with counts and NULL statistics.
    """
    by = [*keys, VARIABLE]
    long = melt(df.filter(F.col(group).isin(a, b)), [*keys, group], columns).filter(F.col(VALUE).isNotNull())
    ina, inb = F.col(group) == a, F.col(group) == b
    pick = lambda p: F.when(p, F.col(VALUE))
    m = long.groupBy(*by).agg(
        F.count_if(ina).alias("n_a"), F.count_if(inb).alias("n_b"), F.avg(pick(ina)).alias("m_a"), F.avg(pick(inb)).alias("m_b"),
        F.var_samp(pick(ina)).alias("v_a"), F.var_samp(pick(inb)).alias("v_b"),
    )
    counts = long.groupBy(*by, VALUE).agg(F.count(F.lit(1)).alias("n"), F.count_if(ina).alias("ca"), F.count_if(inb).alias("cb"))
    ranked = with_less(counts, by, VALUE, also=("ca", "cb")).join(m.select(*by, "n_a", "n_b"), by)
    n = F.col("n").cast("double")
    r = ranked.groupBy(*by).agg(
        F.sum(F.col("ca") * (F.col("less") + (n + 1) / 2)).alias("rank_a"),
        F.sum(n * n * n - n).alias("ties"),
        F.max(F.abs(ratio(F.col("upto_ca"), F.col("n_a")) - ratio(F.col("upto_cb"), F.col("n_b")))).alias("ks_stat"),
    )
    d = m.join(r, by)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    enough = (na >= min_n) & (nb >= min_n)
    sa, sb = ratio(F.col("v_a"), na), ratio(F.col("v_b"), nb)
    diff = F.col("m_a") - F.col("m_b")
    dof = ratio((sa + sb) * (sa + sb), ratio(sa * sa, na - 1) + ratio(sb * sb, nb - 1))
    u = F.col("rank_a") - na * (na + 1) / 2
    total = na + nb
    mu, sd = na * nb / 2, F.sqrt(na * nb / 12.0 * ((total + 1) - ratio(F.col("ties"), total * (total - 1))))
    z = ratio(F.greatest(F.col("u_stat"), na * nb - F.col("u_stat")) - mu - 0.5, sd)
    pooled = F.sqrt((F.col("v_a") + F.col("v_b")) / 2)
    d = d.withColumns({"mean_diff": diff, "t_stat": ratio(diff, F.sqrt(sa + sb)), "dof": dof, "u_stat": u})
    d = d.withColumns({
        "t_p": t_two_sided(F.col("t_stat"), F.col("dof")), "u_p": F.least(F.lit(1.0), 2 * normal_cdf(-z)),
        "ks_p": kolmogorov_sf(F.sqrt(ratio(na * nb, total)) * F.col("ks_stat")),
        "cohens_d": F.when(pooled != 0, diff / pooled).when(pooled == 0, 0.0),
    })
    told = ("mean_diff", "t_stat", "t_p", "u_stat", "u_p", "ks_stat", "ks_p", "cohens_d")
    d = d.withColumns({c: F.when(enough, F.col(c)) for c in told})
    d = d.withColumns({
        **{f"{t}_significant": F.col(f"{t}_p") < alpha for t in ("t", "u", "ks")},
        "effect_size": F.when(F.col("cohens_d").isNotNull(), ladder(F.abs("cohens_d"), EFFECTS, "Large")),
    })
    return d.select(*by, "n_a", "n_b", "mean_diff", "t_stat", "t_p", "t_significant", "u_stat", "u_p", "u_significant", "ks_stat", "ks_p", "ks_significant", "cohens_d", "effect_size")


def kpi_board(df: DataFrame, keys: Sequence[str], season: str, columns: Sequence[str], running_above: float = 0.1, rows_per_hour: float = 2.0) -> DataFrame:
    """Per season and column: mean, variability, range and hours in operation."""
    d = melt(df, [*keys, season], columns).groupBy(*keys, season, VARIABLE).agg(
        F.avg(VALUE).alias("mean"), ratio(100.0 * F.stddev_samp(VALUE), F.avg(VALUE)).alias("cv_pct"),
        (F.max(VALUE) - F.min(VALUE)).alias("range"), (F.count_if(F.col(VALUE) > running_above) / rows_per_hour).alias("operating_hours"))
    return d


def significant_share(tests: DataFrame, keys: Sequence[str], flag: str = "t_significant") -> DataFrame:
    return tests.groupBy(*keys).agg(
        F.count_if(flag).alias("n_significant"), F.count(flag).alias("n_tests"), (100.0 * F.avg(false_if_null(F.col(flag)).cast("int"))).alias("significant_pct"))


