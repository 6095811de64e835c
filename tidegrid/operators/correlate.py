"""Correlation matrices as pair tables, significance, and lag correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import roles
from tidegrid.functions.columns import correlation
from tidegrid.functions.special import t_two_sided
from tidegrid.plans.blocks import rolling
from tidegrid.plans.quantiles import melt
from tidegrid.plans.ranks import average_ranks, value_counts, with_less
from tidegrid.plans.series import Series, attach
from tidegrid.session import durable

# Aggregates per job, marks of derived features, thresholds of the pair reports.
PAIRS_PER_JOB = 60
DERIVED_MARKS = r"(?:_lag(?:_?[0-9]+)?|_rolling(?:_[a-z0-9]+)*|_(?:abs_)?rate(?:_of_change)?)+$"
MIN_PAIRS_FOR_P = 3
ALPHA = 0.05
STRONG, COLLINEAR, WEAK = 0.7, 0.9, 0.3


def pearson_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``keys, variable_1, variable_2, r, n`` on pairwise-complete rows; aggregates only, nothing is sorted."""
    pairs = list(pairs or combinations(columns, 2))
    out = None
    for i in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[i : i + PAIRS_PER_JOB]
        cell = [
            F.struct(
                F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), correlation(a, b).alias("r"),
                F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
            ).alias(f"__{j}") for j, (a, b) in enumerate(part)
        ]
        g = df.groupBy(*keys).agg(*cell)
        g = g.select(*keys, F.explode(F.array(*[F.col(f"__{j}") for j in range(len(part))])).alias("p")).select(*keys, "p.*")
        out = g if out is None else out.unionByName(g)
    return out


def pair_counts(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``keys, variable_1, variable_2, x, y, n``: distinct value pairs of complete rows with their count."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"),
                 F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs
    ])
    d = df.select(*keys, F.explode(cells).alias("p")).select(*keys, "p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    return d.groupBy(*keys, "variable_1", "variable_2", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def spearman_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Rank correlation on pairwise-complete rows, with shared ranks for ties."""
    counts = pair_counts(df, keys, list(pairs or combinations(columns, 2)))
    by = [*keys, "variable_1", "variable_2"]
    d = counts
    for v in ("x", "y"):
        # ranks centred on the mean rank, so the weighted sums below are covariances
        r = average_ranks(counts, by, v, "n").select(*by, v, (F.col("rank") - (F.col("total") + 1) / 2).alias(f"r{v}"))
        d = d.join(r, [*by, v])
    s = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    norm = F.sqrt(s("rx", "rx")) * F.sqrt(s("ry", "ry"))
    return d.groupBy(*by).agg(F.when(norm > 0, s("rx", "ry") / norm).alias("r"), F.sum("n").alias("n"))


def kendall_pairs(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Kendall's tau-b on pairwise-complete rows, exact for any number of rows.

    The number of rows with a smaller x is an integer code of x. Two codes part at one bit: rows whose codes agree above that
    bit are one group, and those with the bit set have the larger x. So for each bit, running counts by y inside the groups
    give the rows of smaller and of larger y on the other side; all pairs of rows are met once in as many passes as a code
    has bits, and no two rows are ever paired.
    """
    by = [*keys, "variable_1", "variable_2"]
    counts = durable(pair_counts(df, keys, list(pairs or combinations(columns, 2))))
    codes = with_less(value_counts(counts, by, "x", "n"), by, "x").select(*by, "x", F.col("less").alias("code"), F.col("n").alias("nx"), "total")
    codes = durable(codes)
    bits = int(codes.agg(F.max("total")).first()[0] or 0).bit_length()
    d = counts.join(codes.select(*by, "x", "code"), [*by, "x"]).withColumn("bit", F.explode(F.array(*[F.lit(b) for b in range(max(bits, 1))])))
    high = F.expr("shiftright(code, bit) & 1")
    d = d.groupBy(*by, "bit", F.expr("shiftright(code, bit + 1)").alias("above"), F.col("y")).agg(
        F.sum("n").alias("n"), F.sum(F.when(high == 0, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(high == 1, F.col("n")).otherwise(0)).alias("high"))
    group = [*by, "bit", "above"]
    d = durable(d)
    sides = d.groupBy(*group).agg(F.sum("low").alias("all_low"), F.sum("high").alias("all_high")).filter("all_low > 0 AND all_high > 0")
    d = with_less(d.join(sides.select(*group), group, "left_semi"), group, "y", also=("low",)).join(sides.select(*group, "all_low"), group)
    # concordant minus discordant: low rows of smaller y less those of larger y
    part = F.col("high").cast("double") * (2 * F.col("upto_low") - F.col("low") - F.col("all_low"))
    score = d.groupBy(*by).agg(F.sum(part).alias("score"))
    same = lambda c: F.sum(c.cast("double") * (c - 1) / 2)
    ties_y = counts.groupBy(*by, "y").agg(F.sum("n").alias("ny")).groupBy(*by).agg(same(F.col("ny")).alias("ty"))
    ties = codes.groupBy(*by).agg(F.max("total").alias("n"), same(F.col("nx")).alias("tx")).join(ties_y, by)
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    norm = F.sqrt(every - F.col("tx")) * F.sqrt(every - F.col("ty"))
    return ties.join(score, by, "left").select(*by, F.when(norm > 0, F.coalesce("score", F.lit(0.0)) / norm).alias("r"), "n")


def p_values(pairs: DataFrame) -> DataFrame:
    """Two-sided p of each coefficient; 1 when fewer than three pairs."""
    r, df = F.col("r"), F.col("n") - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(df / (1 - r * r)))
    p = F.when(F.col("n") < MIN_PAIRS_FOR_P, F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided(t, df))
    return pairs.withColumn("p_value", p)


def fdr(pairs: DataFrame, keys: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Benjamini-Hochberg adjusted p over the pairs of a key (a table of column pairs, not of rows)."""
    up = Window.partitionBy(*keys).orderBy("p_value", "variable_1", "variable_2")
    m = F.count("p_value").over(Window.partitionBy(*keys))
    d = pairs.filter(F.col("p_value").isNotNull()).withColumn("__raw", F.col("p_value") * m / F.row_number().over(up))
    down = Window.partitionBy(*keys).orderBy(F.desc("p_value"), F.desc("variable_1"), F.desc("variable_2"))
    adj = F.least(F.lit(1.0), F.min("__raw").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("p_adjusted", adj).withColumn("is_significant", F.col("p_adjusted") <= alpha).drop("__raw")


def matrix(pairs: DataFrame, keys: Sequence[str], diagonal: float = 1.0) -> DataFrame:
    """Full long matrix from the upper triangle."""
    low = pairs.select(*keys, F.col("variable_2").alias("variable_1"), F.col("variable_1").alias("variable_2"), "r")
    both = pairs.select(*keys, "variable_1", "variable_2", "r").unionByName(low)
    diag = both.select(*keys, "variable_1").distinct().select(*keys, "variable_1", F.col("variable_1").alias("variable_2"), F.lit(diagonal).alias("r"))
    return both.unionByName(diag)


def hygiene(df: DataFrame, columns: Sequence[str], min_coverage: float = 0.7) -> DataFrame:
    """Coverage and variance per column with the keep decision."""
    long = melt(df, [], columns)
    d = long.groupBy("variable").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"), F.var_samp("value").alias("variance"))
    return d.withColumn("keep", F.coalesce((F.col("coverage") >= min_coverage) & (F.col("variance") > 0), F.lit(False)))


def tautology(v1: str = "variable_1", v2: str = "variable_2") -> Column:
    """Whether two features are the same quantity by name: derived from one base, or bases that are one quantity by construction.

    The base is what is left of a name without its trailing marks of lag, rolling window and rate.
    """
    a, b = F.lower(v1), F.lower(v2)
    base_a, base_b = (F.regexp_replace(c, DERIVED_MARKS, "") for c in (a, b))
    derived = (base_a == base_b) & ((base_a != a) | (base_b != b))
    known = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in roles.TAUTOLOGIES])
    crossed = lambda x, y, t: F.contains(x, t["p"]) & F.contains(y, t["q"])
    return derived | F.exists(known, lambda t: crossed(base_a, base_b, t) | crossed(base_b, base_a, t))


def pair_report(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Pairs with absolute value, tautology flag and significance (needs ``p_value``)."""
    return pairs.filter("r IS NOT NULL").withColumns({
        "abs_r": F.abs("r"), "is_tautology": tautology(), "is_significant": F.col("p_value") <= alpha})


def top_pairs(report: DataFrame, n: int = 10, positive: bool = True) -> DataFrame:
    """The ``n`` most positive (or negative) significant pairs that are no tautology."""
    d = report.filter(~F.col("is_tautology") & F.col("is_significant"))
    return d.orderBy(F.desc("r") if positive else F.asc("r"), "variable_1", "variable_2").limit(n)


def strong_pairs(pairs: DataFrame, strong: float = STRONG, collinear: float = COLLINEAR) -> DataFrame:
    return pairs.filter(F.abs("r") >= strong).withColumn("is_multicollinear", F.abs("r") >= collinear)


def weak_variables(pairs: DataFrame, keys: Sequence[str], n_variables: int, limit: float = WEAK) -> DataFrame:
    """Variables whose mean absolute coefficient with the others is small."""
    both = pairs.select(*keys, F.explode(F.array("variable_1", "variable_2")).alias("variable"), F.abs("r").alias("a"))
    d = both.groupBy(*keys, "variable").agg((F.coalesce(F.sum("a"), F.lit(0.0)) / (n_variables - 1)).alias("mean_abs_r"))
    return d.filter(F.col("mean_abs_r") < limit)


def detrend(df: DataFrame, s: Series, column: str, mode: str = "none") -> DataFrame:
    """Drop missing values, then ``none``, ``demean`` (minus the series mean) or ``diff`` (first row dropped)."""
    d = df.select(*s.keys, s.ts, column).dropna(subset=[column])
    if mode == "demean":
        mean = d.groupBy(*s.keys).agg(F.avg(column).alias("__mean"))
        return attach(d, mean, s.keys).withColumn(column, F.col(column) - F.col("__mean")).drop("__mean")
    if mode == "diff":
        return rolling(d, s.with_step(None), 1, 0, lambda w: {column: F.col(column) - F.lag(column).over(w)}).dropna(subset=[column])
    return d


def lag_correlation(df: DataFrame, s: Series, source: str, target: str, max_lag: int, step_hours: float, min_samples: int = 0, mode: str = "none", method: str = "pearson", two_sided: bool = True) -> DataFrame:
    """``keys, lag, lag_hours, r, n``: source shifted by ``lag`` rows (positive: source leads) against target.

    Both series are detrended and restricted to their common stamps first.
    """
    if mode == "none":
        d = df.select(*s.keys, s.ts, source, target).dropna(subset=[source, target])
    else:
        d = detrend(df, s, source, mode).join(detrend(df, s, target, mode), [*s.keys, s.ts])
    lags = list(range(-max_lag if two_sided else 0, max_lag + 1))
    name = lambda k: f"lag{k + max_lag}"
    d = rolling(d, s.with_step(None), max_lag, max_lag if two_sided else 0, lambda w: {
        name(k): (F.lag(source, k) if k >= 0 else F.lead(source, -k)).over(w) for k in lags})
    pairs = [(name(k), target) for k in lags]
    fn = spearman_pairs if method == "spearman" else pearson_pairs
    out = fn(d, s.keys, [], pairs)
    k = F.substring("variable_1", 4, 10).cast("int") - max_lag
    enough = F.col("n") >= min_samples
    return out.select(*s.keys, k.alias("lag"), (k * step_hours).alias("lag_hours"), F.when(enough, F.col("r")).alias("r"), "n")


def optimal_lag(lags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag with the largest absolute coefficient, the earliest on ties."""
    d = lags.filter("r IS NOT NULL")
    best = F.max_by(F.struct("lag", "lag_hours", "r", "n"), F.struct(F.abs("r"), -F.col("lag")))
    return d.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.lag_hours").alias("optimal_lag_hours"), F.col("b.r").alias("optimal_r"), F.col("b.n").alias("n_effective"))


def lag_findings(summary: DataFrame, pair: str = "pair") -> DataFrame:
    """Finding type by the names of the pair."""
    p = F.col(pair)
    has = lambda *w: F.lit(True) if not w else F.contains(p, F.lit(w[0])) & has(*w[1:])
    kind = (
        F.when(has("Esterna", "Ripresa"), "Thermal Response")
        .when(F.contains(F.lower(p), F.lit("error")) & has("Modul"), "Control Latency")
        .when(has("Mandata", "Ripresa"), "Air Distribution")
    )
    return summary.withColumn("finding", kind)
