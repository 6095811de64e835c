"""Hard negatives: Strassen multiplication of anchor and candidate tiles, heaps of positives and of windows merged over tiles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import durable

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least 30 % and at most 90 % of the positive's.
LEAST, MOST = 30, 90
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 2048
#: Side below which a product is computed directly.
LEAF = 32
#: Tiles of a candidate group, whose heaps are merged before those of all groups.
TILES = 64


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices by Strassen's recursion: seven half-size products and exact additions.

    Odd sides are filled with a line of zeros. Arithmetic is modulo 2^64, so each element that fits a long is exact whatever
    the intermediate sums.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), dtype=np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def finite(v: Column) -> Column:
    """A vector whose components are all present and finite."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vectors: DataFrame, label: Column) -> DataFrame:
    """A stored table uid, vec_id, label, x (long components floor(256 c)) of the rows that have a label and a finite vector."""
    d = vectors.select("vec_id", label.alias("label"), "embedding").filter(F.col("label").isNotNull() & finite(F.col("embedding")))
    x = F.transform("embedding", lambda c: F.floor(256 * c.cast("double")))
    return durable(d.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", x.alias("x")))


def tiles(anchors: DataFrame, candidates: DataFrame, anchor_rows: int, candidate_rows: int) -> DataFrame:
    """All rows of the grid of tiles: ablock, cblock, side (0 anchor, 1 candidate) and the row's columns.

    Blocks are drawn by a hash of the row number, so they are even whatever the ids and labels. Each anchor block meets each
    candidate block in one group of about ``anchor_rows + candidate_rows`` rows.
    """
    na, nc = max(1, math.ceil(anchors.count() / anchor_rows)), max(1, math.ceil(candidates.count() / candidate_rows))
    own = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select("*", own(na, 1).alias("ablock"), every(nc).alias("cblock"), F.lit(0).alias("side"))
    c = candidates.select("*", every(na).alias("ablock"), own(nc, 2).alias("cblock"), F.lit(1).alias("side"))
    return a.unionByName(c, allowMissingColumns=True)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter ones are filled with zeros."""
    flat = column.combine_chunks()
    size = flat.value_lengths().to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out


def scored(t: pa.Table) -> tuple[dict, dict, np.ndarray]:
    """Columns of a tile's anchors and of its candidates (by falling id, so that later ones win ties when sorted upwards), and their scores."""
    side = t.column("side").to_numpy()
    width = max(1, int(max(t.column("x").combine_chunks().value_lengths().to_pylist(), default=1)))
    parts = []
    for s in (0, 1):
        own = t.filter(pa.array(side == s))
        if s:
            own = own.take(pc.sort_indices(own, sort_keys=[("vec_id", "descending"), ("uid", "descending")], null_placement="at_start"))
        parts.append({c: own.column(c) for c in own.column_names} | {"m": _matrix(own.column("x"), width)})
    return parts[0], parts[1], product(parts[0]["m"], np.ascontiguousarray(parts[1]["m"].T))


def positive_heap(t: pa.Table, k: int) -> pa.Table:
    """The first k rows of a tile that share an anchor's label, for each of its anchors."""
    a, c, score = scored(t)
    uid, other, ids = a["uid"].to_numpy(), c["uid"].to_numpy(), c["vec_id"].to_pylist()
    same = a["label"].to_numpy()[:, None] == c["label"].to_numpy()
    out = []
    for r in range(len(uid)):
        own = np.flatnonzero(same[r] & (other != uid[r]))
        best = own[np.argsort(score[r, own], kind="stable")[::-1][:k]]
        out += [(uid[r], ids[x], score[r, x]) for x in best]
    return _table(out, ("auid", "positive_id", "positive_score"), t.column("cblock")[0].as_py() if len(t) else 0)


def window_heap(t: pa.Table, k: int) -> pa.Table:
    """The first k rows of another label inside each window of each anchor; anchors carry ``low`` and ``high`` scores by slot."""
    a, c, score = scored(t)
    uid, ids, out = a["uid"].to_numpy(), c["vec_id"].to_pylist(), []
    other = a["label"].to_numpy()[:, None] != c["label"].to_numpy()
    for r, (low, high) in enumerate(zip(a["low"].to_pylist(), a["high"].to_pylist(), strict=True)):
        own = np.flatnonzero(other[r])
        own = own[np.argsort(score[r, own], kind="stable")]
        s = score[r, own]
        for slot, (x, y) in enumerate(zip(low, high, strict=True), 1):
            first, last = np.searchsorted(s, x, side="left"), np.searchsorted(s, y, side="right")
            out += [(uid[r], slot, ids[own[p]], s[p]) for p in range(last - 1, max(first, last - k) - 1, -1)]
    return _table(out, ("auid", "slot", "negative_id", "negative_score"), t.column("cblock")[0].as_py() if len(t) else 0)


def _table(rows: list[tuple], names: tuple[str, ...], cblock: int) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array([None if v is None else int(v) for v in c], type=pa.int64()) for n, c in zip(names, cols, strict=True)} | {"cblock": pa.array([cblock] * len(rows), type=pa.int64())})


def merged(heaps: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """The first k rows of each key over all tiles, with their ``place`` from 1.

    Heaps are merged inside groups of tiles and then over the groups; each merge cuts to k rows before it shuffles too.
    """
    order = [F.desc(score), F.asc_nulls_last(ident)]
    d = heaps.withColumn("tiles", F.floor(F.col("cblock") / TILES))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "tiles").orderBy(*order))).filter(F.col("place") <= k)
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k).drop("tiles", "cblock")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_rows: int = ANCHOR_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """Negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is a table of ``quantised`` and ``anchors`` some of its rows, the query set; every anchor is scored against all
    rows, in tiles. Positives are the first other rows of the anchor's label, negatives the first rows of another label whose
    score is in the window below the positive's; both by falling score and then by vec_id (a missing one last). Repeated rows
    are rows of their own, also as positives of each other. Shorter vectors count as filled with zeros. Scores are exact as
    long as they fit a long. An anchor without positives, or a positive without negatives, has no row.
    """
    heaps = tiles(anchors, rows, anchor_rows, candidate_rows).groupBy("ablock", "cblock").applyInArrow(
        lambda t: positive_heap(t, positives), "auid long, positive_id long, positive_score long, cblock long"
    )
    found = durable(merged(heaps, ["auid"], "positive_score", "positive_id", positives).withColumnRenamed("place", "slot"))
    p = F.col("positive_score").cast("decimal(22,0)")
    # 30 p <= 100 n <= 90 p in whole numbers
    bound = lambda x: F.greatest(F.least(x, F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long")
    limits = found.groupBy("auid").agg(F.sort_array(F.collect_list(F.struct("slot", bound(F.ceil(p * LEAST / 100)).alias("low"), bound(F.floor(p * MOST / 100)).alias("high")))).alias("w"))
    asked = durable(anchors.join(limits.withColumnRenamed("auid", "uid"), "uid").select(*anchors.columns, F.col("w.low").alias("low"), F.col("w.high").alias("high")))
    heaps = tiles(asked, rows, anchor_rows, candidate_rows).groupBy("ablock", "cblock").applyInArrow(
        lambda t: window_heap(t, negatives), "auid long, slot long, negative_id long, negative_score long, cblock long"
    )
    best = merged(heaps, ["auid", "slot"], "negative_score", "negative_id", negatives)
    names = anchors.select(F.col("uid").alias("auid"), F.col("vec_id").alias("anchor_id"))
    d = best.join(durable(found.withColumn("slot", F.col("slot").cast("long"))), ["auid", "slot"]).join(names, "auid")
    return d.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
