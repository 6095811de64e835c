"""Exact ranks of values inside a group of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.plans.blocks import running
from tidegrid.plans.series import BLOCK, Series
from tidegrid.session import durable

#: Distinct values that one bucket holds on average; the number of buckets follows the data.
BUCKET_VALUES = 50_000


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct non-null values with their number of rows: the combine step before ranking."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def with_less(counts: DataFrame, keys: Sequence[str], value: str, rows: int = BUCKET_VALUES, also: Sequence[str] = ()) -> DataFrame:
    """Add ``less``, the number of rows with a smaller value, and ``total`` rows of the group.

    ``counts`` holds distinct values with ``n``.  Values are range partitioned by sampled splitters into buckets of about
    ``rows``, whatever the sizes of the groups: a row finds its bucket by binary search.  Counts are summed inside
    buckets and across them.  ``also`` names further counts to accumulate as ``upto_<name>``.
    """
    keys = list(keys)
    counts = durable(counts)
    buckets = max(1, -(-counts.count() // rows))
    # stored with its bucket, so that every reader sees the same splitters
    d = durable(counts.repartitionByRange(buckets, *keys, value).withColumn(BLOCK, F.spark_partition_id().cast("bigint")))
    d = running(d, Series(tuple(keys), value), {"__upto": ("sum", F.col("n")), **{f"upto_{c}": ("sum", F.col(c)) for c in also}}, {"__from": ("sum", F.col("n"))})
    d = d.withColumns({"less": F.col("__upto") - F.col("n"), "total": F.col("__upto") + F.col("__from") - F.col("n")})
    return d.drop("__upto", "__from")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """``keys, value, n, less, total, rank`` with ties sharing their mean one-based rank."""
    d = with_less(value_counts(df, keys, value, weight), keys, value)
    return d.withColumn("rank", F.col("less") + (F.col("n") + 1) / 2)
