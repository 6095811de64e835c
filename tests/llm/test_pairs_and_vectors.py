"""Golay SimHash, Strassen hard negatives and QDWH whitening against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidegrid.llm import golay, queries, strassen, whitening

VECTOR = "vec_id long, embedding array<float>, label int"


# --- Golay SimHash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(doc_id, fingerprint, component) with links between all pairs of at most 4 differing bits."""
    fp = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)].append(d)
    return sorted(((d, f"{fp[k]:016x}", min(least[find(k)], default=None)) for k, (d, _) in enumerate(rows)), key=str)


def odd_texts():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeé"), 4))
    base = [word() for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\x0b"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (6, "ein zwei drei"), (7, "a b c d " * 30000)]
    for k in range(60):
        own = list(base)
        for _ in range(k % 12):
            own[int(rng.integers(400))] = word()
        rows.append((100 - k, " ".join(own)))
    return rows + [(200 + k, " ".join(word() for _ in range(40))) for k in range(60)] + [(300, "a\x1cb c d e f")]


@pytest.mark.parametrize("large", [golay.LARGE, 3])
def test_golay_components_equal_brute_force(spark, large):
    rows = odd_texts()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, bucket int").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in golay.near_duplicates(d, large).collect()), key=str)
    assert got == brute_components(rows)


def test_golay_of_an_empty_table(spark):
    assert golay.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_code_is_perfect_and_near_fingerprints_share_a_key():
    assert (np.bincount(golay.decoded(np.arange(1 << 23))) == 1 << 11).all()
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False)
    near = fp.copy()
    for k in range(len(near)):
        for b in rng.choice(64, 4, replace=False):
            near[k] ^= np.uint64(1 << int(b))
    for keys in (golay.golay_keys, golay.piece_keys, golay.midpoint_keys):
        one, two = keys(fp[:200]), keys(near[:200])
        sets = [defaultdict(set), defaultdict(set)]
        for s, (row, key) in zip(sets, (one, two), strict=True):
            for r, k in zip(row.tolist(), key.tolist(), strict=True):
                s[r].add(k)
        assert all(sets[0][k] & sets[1][k] for k in range(200))


def test_a_clump_of_near_fingerprints_is_one_component_at_any_bucket_size(spark):
    rng = np.random.default_rng(3)
    walk, clump = 0x0123456789ABCDEF, []
    for _ in range(300):
        for b in rng.choice(64, 2, replace=False):
            walk ^= 1 << int(b)
        clump.append(walk)
    rows = sorted({x - (1 << 64) if x >> 63 else x for x in clump})
    d = spark.createDataFrame([(x,) for x in rows], "fp long")
    for large in (4096, 4):
        links = golay.all_links(d, large).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
        assert golay.components(golay.all_links(d, large)).select("label").distinct().count() == 1


# --- Strassen hard negatives


def brute_negatives(rows):
    """Lists of ((vec_id, x, label)) by plain integer arithmetic; rows are (vec_id, vector, label)."""
    own = [(v, [math.floor(256 * float(np.float32(c))) for c in e], b) for v, e, b in rows if b is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)]
    own = [(v, x, (b + 1) % 10 if v is not None and v % 7 == 0 else b) for v, x, b in own]
    by = lambda s: sorted(s, key=lambda t: (-t[0], t[1] is None, t[1] or 0))
    out = []
    for a, (v, x, b) in enumerate(own):
        if v is None or v % 100:
            continue
        scores = [(sum(p * q for p, q in zip(x, y, strict=False)), u, c, k) for k, (u, y, c) in enumerate(own) if k != a]
        for p, pid in [s[:2] for s in by(s for s in scores if s[2] == b)][:5]:
            inside = [s for s in by(s for s in scores if s[2] != b) if 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(v, pid, k, s[1], p, s[0]) for k, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def test_strassen_equals_the_plain_product():
    rng = np.random.default_rng(4)
    for m, k, n in ((1, 1, 1), (0, 3, 2), (5, 7, 3), (33, 65, 70), (100, 51, 77)):
        a, b = rng.integers(-(2**40), 2**40, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        assert (strassen.product(a, b, 4) == a @ b).all()
    big = np.full((9, 9), 2**61)
    # intermediate sums pass 2^63, the result fits
    assert (strassen.product(big, np.eye(9, dtype=np.int64), 2) == big).all()


@pytest.mark.parametrize("tile", [(512, 2048), (2, 16)])
def test_hard_negatives_equal_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(k, (centres[k % 4] + rng.normal(size=6) / 2).tolist(), k % 4) for k in range(220)]
    rows += [(300, None, 1), (301, [1.0, None] * 3, 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 2), (304, rows[3][1], None), (None, rows[4][1], 2), (None, rows[4][1], 2)]
    rows += [(100, rows[100][1], 1), (17, rows[17][1], 1), (17, rows[17][1], 1), (400, [0.0] * 6, 3), (500, [], 2), (501, [1.0, 2.0], 0), (600, (-centres[1]).tolist(), 9)]
    d = spark.createDataFrame([(*r, 1, "s") for r in rows], VECTOR + ", uid int, side string").repartition(3)
    wrong = lambda q: q.F.when(q.F.col("vec_id") % 7 == 0, (q.F.col("label") + 1) % 10).otherwise(q.F.col("label"))
    x = strassen.quantised(d, wrong(queries))
    got = strassen.hard_negatives(x, x.filter("vec_id % 100 = 0"), anchor_rows=tile[0], candidate_rows=tile[1]).collect()
    assert got and sorted(map(tuple, got), key=str) == brute_negatives(rows)


def test_hard_negatives_of_an_empty_table(spark):
    x = strassen.quantised(spark.createDataFrame([], VECTOR), queries.F.col("label"))
    assert strassen.hard_negatives(x, x).count() == 0


# --- whitening


def test_spectrum_equals_the_library_and_takes_equal_eigenvalues():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 32, 64):
        m = rng.normal(size=(300, n)) * rng.uniform(0.5, 2, n)
        a = np.cov(m.T).reshape(n, n)
        e, v = whitening.spectrum(a)
        ref, own = np.linalg.eigh(a)
        own = own[:, ::-1]
        assert np.allclose(e, ref[::-1], rtol=1e-12) and np.abs(v - own * np.sign((v * own).sum(axis=0))).max() < 1e-11
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    for a in (np.eye(5), np.zeros((4, 4)), np.diag([1.0, 1, 2, 2, 3, 0, 0]), q @ np.diag([5.0] * 4 + [1] * 5 + [0] * 3) @ q.T):
        e, v = whitening.spectrum(a)
        assert np.allclose(v.T @ v, np.eye(len(a)), atol=1e-13) and np.allclose(a @ v, v * e, atol=1e-12) and (np.diff(e) <= 1e-12).all()


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(20, 20))
    e, v = np.linalg.eigh(a + a.T)
    assert np.allclose(whitening.polar(a + a.T), v @ np.diag(np.sign(e)) @ v.T, atol=1e-12)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=20) * np.linspace(0.2, 2, 20)).astype(np.float32).tolist(), 1) for k in range(300)]
    rows += [rows[5]] * 40 + [(None, rows[6][1], None), (400, None, 1), (401, [None] * 20, 1), (402, [float("nan")] + [0.0] * 19, 1), (403, [float("-inf")] * 20, 1), (404, [0.5], 1), (405, [], 2)]
    d = spark.createDataFrame([(*r, 1.5) for r in rows], VECTOR + ", x double").repartition(4)
    got = whitening.whitened(d).collect()
    used = [(v, [math.floor(64 * c) + 1000000 for c in e] + [1000000] * (20 - len(e))) for v, e, _ in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array(fit, dtype=float) - np.array(sums) / n
    e, v = np.linalg.eigh(m.T @ m / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 16 * len(used)
    want = defaultdict(list)
    for i, x in used:
        want[i].append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - np.array(sums) / n) @ v / np.sqrt(e)))
    sign = {}
    for r in got:
        k = r.component - 1
        assert r.n == n and abs(r.explained / (e[k] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
        hits = [w for w in want[r.vec_id] if w[0] == r.deviation]
        assert hits and min(abs(abs(r.whitened) - abs(w[1][k])) for w in hits) < 1e-8
        if abs(r.whitened) > 0.1:
            sign.setdefault(k, set()).add(np.sign(r.whitened) * np.sign(hits[0][1][k]))
    assert all(len(s) == 1 for s in sign.values())


def test_whitening_without_rows_or_variance(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTOR)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, VECTOR)).count() == 0
    flat = [(k, [float(k), 3.0, float(k)], 1) for k in range(9)]
    got = whitening.whitened(spark.createDataFrame(flat, VECTOR)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and got[0].identity_error < 1e-9


def test_deviations_beyond_small_numbers_are_exact():
    w = {"n": 10**8, "sums": [10**14 + 7, 10**14 - 9]}
    m = np.array([[1000005, 999990], [1000000, 1000001]])
    assert whitening.deviations(m, w) == [sum((w["n"] * int(x) - s) ** 2 for x, s in zip(r, w["sums"], strict=True)) for r in m]
