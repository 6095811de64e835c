"""Embedding whitening: exact covariance in Spark, its components by QDWH spectral divide and conquer, whitened rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.strassen import finite
from tidegrid.session import durable

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
EPS = np.finfo(float).eps


# --- components of a symmetric matrix


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley iteration.

    For a symmetric matrix it is the matrix sign: 1 on the invariant subspace of positive eigenvalues, -1 on the other.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    # a lower bound of the smallest singular value; a lower one than needed costs a few steps
    low = EPS
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-10 and low > 0.5:
            break
    return x


def split(a: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces of the eigenvalues above and below ``at``, from the spectral projector (I + U) / 2."""
    n = len(a)
    above = (np.eye(n) + polar(a - at * np.eye(n))) / 2
    rank = int(round(np.trace(above)))
    # columns of the projector by falling length span its range; a second step cleans the basis
    order = np.argsort(-np.diag(above), kind="stable")
    q, _ = np.linalg.qr(above[:, order])
    q, _ = np.linalg.qr(np.hstack([above @ q[:, :rank], q[:, rank:]]))
    return q[:, :rank], q[:, rank:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix by falling size, and their unit vectors as columns.

    The matrix is halved along invariant subspaces until a part is a multiple of the identity (one dimension, or equal
    eigenvalues, of which any basis serves). Each vector's largest entry is positive.
    """
    scale = max(float(np.linalg.norm(a)), np.finfo(float).tiny)

    def parts(v: np.ndarray) -> list[tuple[float, np.ndarray]]:
        own = v.T @ a @ v
        own = (own + own.T) / 2
        mean = float(np.trace(own) / len(own))
        if len(own) == 1 or np.linalg.norm(own - mean * np.eye(len(own))) <= 4 * EPS * scale:
            return [(float(x @ a @ x), x) for x in v.T]
        # the middle of the diagonal halves best; the mean has eigenvalues on both sides always
        for at in (float(np.median(np.diag(own))), mean):
            up, down = split(own, at)
            rest = np.linalg.norm(up.T @ own @ down) if up.shape[1] and down.shape[1] else np.inf
            if rest <= 1e4 * EPS * scale:
                break
        else:
            # an eigenvalue within rounding of both shifts: halfway to the largest diagonal entry
            up, down = split(own, (mean + float(np.diag(own).max())) / 2)
            if not up.shape[1] or not down.shape[1]:
                return [(float(x @ a @ x), x) for x in v.T]
        return parts(v @ up) + parts(v @ down)

    found = sorted(parts(np.eye(len(a))), key=lambda p: -p[0]) if len(a) else []
    values = np.array([e for e, _ in found])
    vectors = np.array([x for _, x in found]).T.reshape(len(a), len(found))
    # one step of correction inside the whole basis: rounding of the splits is removed to first order
    vectors = _corrected(a, vectors)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors) if len(a) else values
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if len(a) else np.ones(0)
    return values[order], vectors * sign


def _corrected(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Orthonormal vectors moved by what their products with ``a`` leave off the diagonal."""
    if not len(a):
        return v
    v, _ = np.linalg.qr(v)
    own = v.T @ a @ v
    gap = np.diag(own)[None, :] - np.diag(own)[:, None]
    near = np.abs(gap) <= 1e-9 * max(np.abs(own).max(), np.finfo(float).tiny)
    turn = np.where(near, 0.0, own / np.where(near, 1.0, gap))
    q, r = np.linalg.qr(v + v @ turn)
    return q * np.sign(np.diag(r))


# --- statistics


def quantised(vectors: DataFrame) -> DataFrame:
    """A stored table vec_id, x (long entries floor(64 c) + 1000000) of the rows whose vector is present and finite.

    A vector shorter than the longest is filled with entries of zero.
    """
    d = vectors.select("vec_id", "embedding").filter(finite(F.col("embedding")))
    d = durable(d.select("vec_id", F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")) + SHIFT).alias("x")))
    width = d.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("w")).scalar()
    return d.select("vec_id", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), width - F.size("x"))).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(rows: DataFrame, column: str, kind: str, prepare) -> tuple[int, list, list]:
    """n, sums and sums of products of the rows that ``prepare`` makes of each batch of vectors.

    A task adds up its rows and sends one row for each element; Spark adds those up, so only dim * (dim + 3) / 2 numbers come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                m = prepare(matrix(batch.column(0).slice(first, 4096)))
                if total is None:
                    total, products = np.zeros(m.shape[1], dtype=m.dtype), np.zeros((m.shape[1],) * 2, dtype=m.dtype)
                n, total, products = n + len(m), total + m.sum(axis=0), products + m.T @ m
        if n:
            i, j = np.triu_indices(len(total))
            own = [pa.array(np.concatenate([[-1], np.full(len(total), -1), i])), pa.array(np.concatenate([[-1], np.arange(len(total)), j]))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([np.array([n], dtype=total.dtype), total, products[i, j]]))], names=["i", "j", "v"])

    parts = rows.select(column).mapInArrow(run, f"i long, j long, v {kind}")
    add = F.sum(F.col("v").cast("decimal(38,0)")) if kind == "long" else F.sum("v")
    got = {(r.i, r.j): r.v for r in parts.groupBy("i", "j").agg(add.alias("v")).collect()}
    number = int if kind == "long" else float
    n = int(got.get((-1, -1), 0))
    width = sum(1 for i, j in got if i == -1 and j >= 0)
    return n, [number(got[-1, j]) for j in range(width)], [[number(got[min(i, j), max(i, j)]) for j in range(width)] for i in range(width)]


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the exact sums S, and the covariance of distinct vectors, rounded once an element.

    Entries are centred on a whole number near their mean before they are multiplied, in whole numbers; what the centre
    misses of the mean is taken off exactly.
    """
    n, sums, _ = moments(fit, "x", "long", lambda m: m)
    centre = [s // n for s in sums] if n else []
    _, left, products = moments(fit, "x", "long", lambda m, c=np.array(centre, dtype=np.int64): m - c)
    width = len(sums)
    v = np.array([[(n * products[i][j] - left[i] * left[j]) / (n * n) for j in range(width)] for i in range(width)]).reshape(width, width)
    return n, sums, v


def whitener(fit: DataFrame, components: int = COMPONENTS) -> dict:
    """What is needed to whiten a row: n, sums, projection (dim by components, over the root of the eigenvalue), explained shares.

    Components of an eigenvalue of zero (up to rounding) can't be whitened and are left out.
    """
    n, sums, v = covariance(fit)
    values, vectors = spectrum(v)
    trace = float(np.trace(v)) if n else 0.0
    k = int(min(components, (values > len(v) * EPS * trace).sum())) if trace > 0 else 0
    return {"n": n, "sums": sums, "projection": vectors[:, :k] / np.sqrt(values[:k]) if k else np.zeros((len(sums), 0)), "explained": values[:k] / trace if k else np.zeros(0)}


def projected(m: np.ndarray, w: dict) -> np.ndarray:
    """Rows x - S / n on the components, unrounded: the whole part of the mean is taken off in whole numbers first."""
    n = max(w["n"], 1)
    whole = np.array([s // n for s in w["sums"]], dtype=np.int64)
    part = np.array([(s % n) / n for s in w["sums"]])
    return ((m - whole) - part) @ w["projection"]


def deviations(m: np.ndarray, w: dict) -> list[int]:
    """Sum over dimensions of (n x - S)^2 as exact whole numbers."""
    n, sums = w["n"], w["sums"]
    most = max((max(abs(n * int(hi) - s), abs(n * int(lo) - s)) for hi, lo, s in zip(m.max(axis=0, initial=0), m.min(axis=0, initial=0), sums, strict=True)), default=0)
    if most * most * max(len(sums), 1) < 1 << 62:
        d = n * m - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in m.tolist()]


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The covariance is over each distinct vector once, so copies weigh nothing. ``identity_error`` is measured on the whitened
    rows of the same list. Rows whose vector is missing or has a missing or non-finite entry are left out; repeated rows
    and missing ids come out as they go in. Without variance there are no components and no rows. The only things broadcast
    are the sums and the projection: dim * (components + 1) numbers. A deviation beyond a long (about 10^8 distinct vectors of 64
    dimensions) is an error.
    """
    rows = durable(quantised(vectors))
    fit = durable(rows.select("x").distinct())
    w = whitener(fit, components)
    k = w["projection"].shape[1]
    n, sums, products = moments(fit, "x", "double", lambda m: projected(m, w)) if k else (1, [], [])
    mean = np.array(sums) / n
    error = float(np.abs(np.array(products) / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows if k else 0, 1024):
                part = batch.slice(first, 1024)
                m = matrix(part.column("x"))
                each = lambda a: pa.array(np.repeat(a, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(each(np.arange(len(m)))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), each(np.full(len(m), w["n"], dtype=np.int64)),
                        each(np.array(deviations(m, w), dtype=np.int64)), pa.array(projected(m, w).ravel()), pa.array(np.tile(w["explained"], len(m))), pa.array(np.full(k * len(m), error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
