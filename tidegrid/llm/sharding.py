"""Weighted rendezvous hashing of stable keys, and gapless slots inside each shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.common import as_row
from tidegrid.session import durable

#: Modulus of the per-shard hash; products of two residues fit a signed long.
PRIME = 2147483647
ROWS_A_BLOCK = 200_000


def key_residues(key: Column) -> tuple[Column, Column, Column]:
    """Three residues of 28 bits of the key's md5; a missing key counts as the word null."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return tuple(F.conv(F.substring(digest, 1 + 7 * k, 7), 16, 10).cast("long") for k in range(3))


def point(residues: tuple[Column, Column, Column], shard: Column) -> Column:
    """The key's hash for one shard, in [0, PRIME): a shard-dependent cubic of the residues."""
    a, b, c = residues
    x = (a + (shard + 1) * (1_000_003 * 97)) % PRIME
    y = (x * ((x + b) % PRIME)) % PRIME
    return (y * ((x + c + shard) % PRIME) + b) % PRIME


def winner(residues: tuple[Column, Column, Column], weights: Sequence[float], first: int = 0) -> Column:
    """Least draw and its shard, of the shards ``first``, ``first + 1``, ...: draws are -ln(u) / weight, ties go to the lower shard."""
    own = F.array(*[F.struct(F.lit(first + k).cast("long").alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights) if w > 0])
    draw = lambda s: -F.log((point(residues, s["shard"]) + F.lit(0.5)) / F.lit(float(PRIME))) / s["weight"]
    return F.array_min(F.transform(own, lambda s: F.struct(draw(s).alias("draw"), s["shard"].cast("int").alias("shard"))))


def checked(weights: Sequence[float]) -> Sequence[float]:
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are not negative, and one at least is positive")
    return weights


def _residue_column(key: str) -> Column:
    return F.struct(*[r.alias(f"r{k}") for k, r in enumerate(key_residues(F.col(key)))])


def _residues(c: str) -> tuple[Column, Column, Column]:
    return F.col(f"{c}.r0"), F.col(f"{c}.r1"), F.col(f"{c}.r2")


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; equal keys share a shard, a missing key is a key of its own.

    A shard of twice the weight wins twice as many keys; one of weight 0 wins none. A draw depends on the key and on that
    shard alone, so a new shard only takes keys into itself, and a removed one only gives its own away.
    """
    d = df.select(as_row(df), _residue_column(key).alias("res"))
    return d.select("row.*", winner(_residues("res"), checked(weights))["shard"].alias(out))


def with_slots(df: DataFrame, group: str, order: Column, out: str = "slot") -> DataFrame:
    """Numbers 0, 1, ... without a gap inside each group, by ``order`` (a long in [0, PRIME)) and then all columns.

    Equal rows are counted first and given back afterwards, so they never meet in one sort. Blocks are
    ranges of ``order`` of about ROWS_A_BLOCK rows: one task sorts one block, and a running sum over the
    block counts (one row a block) gives each block's first slot.
    """
    names = df.columns
    rows = durable(df.withColumn("_order", order).groupBy(*names, "_order").agg(F.count(F.lit(1)).alias("_n")))
    total = rows.agg(F.sum("_n")).first()[0] or 0
    groups = max(1, rows.select(group).distinct().count())
    blocks = max(1, total // (ROWS_A_BLOCK * groups) + 1)
    rows = rows.withColumn("_block", F.expr(f"_order * {blocks}L div {PRIME}L"))
    # groups are joined null-safe by a code, for a missing group is a group too
    rows = rows.withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("null")))
    sums = rows.groupBy("_group", "_block").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_group", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_group", "_block").orderBy("_order", *[F.col(c).asc_nulls_first() for c in names]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(sums, ["_group", "_block"])
    # equal rows come back in runs of a bounded length, which are dealt out before they are expanded
    step = 10_000
    rows = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {step}"))))
    rows = rows.repartition(F.col("_group"), F.col("_block"), F.col("_order"), F.col("_run"))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.col("_run") * step, F.least(F.col("_n"), (F.col("_run") + 1) * step) - 1)))
    return rows.select(*names, (F.col("_base") + F.col("_first") + F.col("_k")).alias(out))


def shard_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Shards of documents by ``doc_id``, with sizes, checksums, slots and the shard if one more of weight 1 came.

    Empty and missing texts have size 16 and checksum 0. Repeated rows get a slot each; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    d = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    d = d.withColumn("_res", _residue_column("doc_id"))
    d = d.withColumn("_best", winner(_residues("_res"), checked(weights)))
    grown = F.least("_best", winner(_residues("_res"), [1.0], len(weights)))
    d = d.withColumns({"shard": F.col("_best.shard"), "grown_shard": grown["shard"]})
    order = ((F.col("_res.r0") + F.col("text_crc32")) * 48271 + F.col("size")) % PRIME
    d = d.select("doc_id", "size", "text_crc32", "shard", "grown_shard", order.alias("place"))
    return with_slots(d, "shard", F.col("place")).drop("place").withColumn("law", F.lit("key"))
