"""Exact quantiles without sorting or collecting a group in one place.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.  Here
a sketch first brackets each wanted rank; a second pass counts what lies between
the brackets of all ranks and keeps only the distinct values inside them (about
0.1 % of the group), from which the exact order statistics are read.  A row is
counted once, however many ranks are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VARIABLE, VALUE = "variable", "value"


def melt(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long form ``keys, variable, value`` of the given columns as DOUBLE, NULLs kept."""
    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return d.unpivot(list(keys), list(cols), VARIABLE, VALUE)


def long_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """``keys, n, q`` with ``q`` the linear-interpolated quantiles of column ``value``."""
    keys, eps = list(keys), 5.0 / accuracy
    long = long.filter(F.col(VALUE).isNotNull()).select(*keys, VALUE)
    wanted = [max(p - eps, 0.0) for p in probs] + [min(p + eps, 1.0) for p in probs]
    if keys:
        sketch = long.groupBy(*keys)
    else:
        sketch = long.groupBy()
    edges = sketch.agg(
        F.percentile_approx(VALUE, wanted, accuracy).alias("__e"), F.count(F.lit(1)).alias("n")
    )
    if keys:
        d = long.join(edges, keys)
    else:
        one = edges.select(F.struct("__e", "n")).scalar()
        d = long.withColumn("__s", one).select(VALUE, "__s.__e", "__s.n")
    m = len(probs)
    lo, hi, v = (lambda i: F.col("__e")[i]), (lambda i: F.col("__e")[m + i]), F.col(VALUE)
    # one row in, one row out: a value inside a bracket is counted by itself, all others by the brackets around them
    inside, place = F.lit(False), F.lit(0)
    for i in range(m):
        inside = inside | v.between(lo(i), hi(i))
        place = place + (v >= lo(i)).cast("int") + (v > hi(i)).cast("int")
    d = d.withColumn("__in", F.when(inside, v)).withColumn("__place", F.when(~inside, place))
    d = d.groupBy(*keys, "n", "__e", "__place", "__in").agg(F.count(F.lit(1)).alias("__c"), F.min(VALUE).alias("__mn"), F.max(VALUE).alias("__mx"))
    # what is left is small: each rank reads it with its own bracket
    ranks = F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(float(p)).alias("__p"), lo(i).alias("__lo"), hi(i).alias("__hi")) for i, p in enumerate(probs)])
    d = d.withColumn("__r", F.explode(ranks)).select(*keys, "n", "__in", "__c", "__mn", "__mx", "__r.*")
    side = F.when(F.col("__mx") < F.col("__lo"), 0).when(F.col("__mn") > F.col("__hi"), 2).otherwise(1)
    d = d.withColumn("__side", side).withColumn("__in", F.when(F.col("__side") == 1, F.col("__in")))
    d = d.groupBy(*keys, "n", "__i", "__p", "__side", "__in").agg(F.sum("__c").alias("__c"), F.min("__mn").alias("__mn"), F.max("__mx").alias("__mx"))
    w = Window.partitionBy(*keys, "__i").orderBy("__side", "__in")
    d = d.withColumn("__cum", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = (F.col("n") - 1) * F.col("__p")
    d = d.withColumn("__k", F.floor(h)).withColumn("__h", h)

    def at(rank: Column) -> Column:
        """Value of the order statistic if this row covers the rank."""
        first = F.col("__cum") - F.col("__c")
        known = (
            F.when(F.col("__side") == 1, F.col("__in"))
            .when((F.col("__side") == 0) & (rank == F.col("__cum") - 1), F.col("__mx"))
            .when((F.col("__side") == 2) & (rank == first), F.col("__mn"))
        )
        return F.max(F.when((rank >= first) & (rank < F.col("__cum")), known))

    d = d.groupBy(*keys, "__i", "n", "__h", "__k").agg(
        at(F.col("__k")).alias("__a"), at(F.least(F.col("__k") + 1, F.col("n") - 1)).alias("__b")
    )
    miss = F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double")
    value = F.coalesce(F.col("__a"), miss) + (F.coalesce(F.col("__b"), miss) - F.col("__a")) * (F.col("__h") - F.col("__k"))
    d = d.withColumn("__v", value)
    return d.groupBy(*keys, "n").agg(
        F.array(*[F.max(F.when(F.col("__i") == i, F.col("__v"))) for i in range(m)]).alias("q")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys, variable, n, q[]`` for each numeric column."""
    return long_quantiles(melt(df, keys, cols), [*keys, VARIABLE], probs)


def wide_quantiles(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float], name=lambda c, i: f"{c}_q{i}"
) -> DataFrame:
    """One row per key with a column per (column, probability)."""
    q = exact_quantiles(df, keys, cols, probs)
    aggs = [
        F.max(F.when(F.col(VARIABLE) == c, F.col("q")[i])).alias(name(c, i))
        for c in cols for i in range(len(probs))
    ]
    return q.groupBy(*keys).agg(*aggs)
