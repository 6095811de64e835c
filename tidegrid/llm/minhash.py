"""Near-duplicate groups: DartMinHash signatures, banded joining, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import as_row, joined, mix, odd_constants, pieces, token_hashes, word_ranges
from tidegrid.session import durable

WORDS, SIMILARITY = 5, 0.8
#: 36 bands of 6 coordinates: a pair of similarity 0.8 shares no band with probability 2e-5, one of 0.3 shares one with probability 0.03.
BANDS, WIDTH = 36, 6
#: Signature agreement from which pairs inside a large bucket are verified: a pair of similarity 0.8 agrees less with probability 7e-7, far below that of sharing no band.
AGREEMENT = 0.66
#: Rows of a bucket that meet in one task when its pairs are compared.
BLOCK = 256
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: index of the text, 64-bit hash, number of times. Sorted by text and hash.

    ASCII letters are taken in lower case. A text of fewer words than a shingle has one shingle of all its words; one without
    words has none.
    """
    data, starts = joined([t.lower() for t in texts])
    first, last = word_ranges(data)
    doc = np.searchsorted(starts, first, side="right") - 1
    h = token_hashes(data, first, last)
    words = np.bincount(doc, minlength=len(texts))
    n = np.where(words > 0, np.maximum(words - WORDS + 1, 1), 0)
    at = np.repeat(np.cumsum(words) - words, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(np.arange(len(texts)), n)
    whole = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(odd_constants(11, WORDS)):
            inside = k < words[own]
            whole[inside] += mix(h[at[inside] + k] + np.uint64(k)) * c
    whole = mix(whole)
    order = np.lexsort((whole, own))
    own, whole = own[order], whole[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (whole[1:] != whole[:-1])
    where = np.flatnonzero(new)
    return own[where], whole[where], np.diff(np.append(where, len(own)))


@lru_cache(maxsize=1)
def _counts() -> np.ndarray:
    """Distribution function of the number of darts in a region of area 1 (Poisson of mean 1)."""
    p = np.cumprod(np.append(np.exp(-1.0), 1 / np.arange(1, 20)))
    return np.cumsum(p)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _throw(sig: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, size: int) -> None:
    """Throws the darts of weighted elements up to each document's rank limit, and keeps the earliest per coordinate in ``sig``.

    The plane of weight and rank of an element is cut into regions of area 1: weights from 2^v - 1 to 2^(v+1) - 1, ranks in
    steps of 2^-v. Element and region alone decide how many darts lie there and where, so equal elements of two documents
    have equal darts. A dart counts if its weight is below the element's.
    """
    with np.errstate(over="ignore"):
        for level in range(int(np.log2(1 + weight.max(initial=0))) + 1):
            low, height = 2.0**level - 1, 2.0**-level
            own = np.flatnonzero(weight > low)
            n = np.ceil(limit[doc[own]] / height).astype(np.int64)
            cell = np.repeat(own, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seed = mix(element[cell] + mix((step.astype(np.uint64) << np.uint64(6)) + np.uint64(level + 1)))
            darts = np.searchsorted(_counts(), _unit(seed), side="right")
            which = np.repeat(np.arange(len(cell)), darts)
            k = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(seed[which] + (k + 1).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A35))
            a = mix(dart + np.uint64(1))
            rank = (step[which] + _unit(mix(dart + np.uint64(2)))) * height
            d = doc[cell[which]]
            hit = (low + _unit(a) / height < weight[cell[which]]) & (rank < limit[d])
            d, dart, rank = d[hit], dart[hit], rank[hit]
            value = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
            np.minimum.at(sig, d * size + (mix(dart + np.uint64(3)) % np.uint64(size)).astype(np.int64), value)


def signatures(n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, size: int = BANDS * WIDTH) -> np.ndarray:
    """DartMinHash of n documents given as (document, element, weight > 0) triples: an n by ``size`` array of dart fingerprints.

    Two documents agree in a coordinate with the probability of their weighted Jaccard similarity. The rank limit of a
    document is set for ``size`` ln ``size`` + 2 ``size`` expected darts, whatever the number of its elements; where a
    coordinate gets none the limit is doubled. Documents without elements have zeros.
    """
    sig = np.full(n * size, _NONE, dtype=np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n)
    limit = np.divide(size * (np.log(size) + 2), total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    slice_ = 1 << 20
    while todo.any():
        own = np.flatnonzero(todo[doc])
        for a in range(0, len(own), slice_):
            part = own[a : a + slice_]
            _throw(sig, doc[part], element[part], weight[part], limit, size)
        todo &= (sig.reshape(n, size) == _NONE).any(axis=1)
        limit = np.where(todo, 2 * limit, limit)
    out = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, size)
    out[total <= 0] = 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    c = odd_constants(5, WIDTH)
    with np.errstate(over="ignore"):
        sums = (mix(sig.reshape(len(sig), BANDS, WIDTH).astype(np.uint64)) * c).sum(axis=2, dtype=np.uint64)
        return mix(sums + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def signed(docs: DataFrame, counted: bool = False) -> DataFrame:
    """A stored table with a row for each row of (doc_id, text): uid, doc_id, digest (of the text), bands, sketch (a byte a coordinate).

    ``counted`` weighs a shingle by its number of occurrences; otherwise each distinct shingle weighs 1, and similarity is
    the Jaccard similarity of shingle sets. ``uid`` numbers the stored rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in pieces(texts, 1 << 20):
                for first in range(a, b, 512):
                    last = min(b, first + 512)
                    doc, element, times = shingles(texts[first:last])
                    sig = signatures(last - first, doc, element, times.astype(np.float64) if counted else np.ones(len(doc)))
                    keys = band_keys(sig)
                    filled = np.bincount(doc, minlength=last - first) > 0
                    rows = batch.slice(first, last - first)
                    bands = pa.array([k if f else [] for k, f in zip(keys.tolist(), filled, strict=True)], type=pa.list_(pa.int64()))
                    sketch = pa.array([s.tobytes() for s in sig.astype(np.uint8)], type=pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.column("uid"), rows.column("doc_id"), rows.column("digest"), bands, sketch], names=["uid", "doc_id", "digest", "bands", "sketch"])

    d = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", digest().alias("digest"), "text")
    return durable(d.mapInArrow(run, "uid long, doc_id long, digest string, bands array<long>, sketch binary"))


def digest():
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least the similarity; ``texts`` has uid and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([(t or "").encode() for t in batch.column(c).to_pylist()] for c in ("text_a", "text_b"))
            keep = []
            both = [t for pair in zip(one, two, strict=True) for t in pair]
            for a, b in pieces(both, 1 << 20):
                # pieces may part a pair, whose first text then waits in the next call
                keep.append(shingles(both[a:b])[:2] + (a,))
            doc = np.concatenate([k[0] + k[2] for k in keep]) if keep else np.empty(0, dtype=np.int64)
            h = np.concatenate([k[1] for k in keep]) if keep else np.empty(0, dtype=np.uint64)
            n = np.bincount(doc, minlength=len(both)).reshape(-1, 2).sum(axis=1)
            order = np.lexsort((h, doc >> 1))
            pair, h = doc[order] >> 1, h[order]
            common = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=len(n))
            similarity = np.divide(common, n - common, out=np.zeros(len(n)), where=n > common)
            out = batch.select(["a", "b"]).filter(pa.array(similarity >= least))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(similarity[similarity >= least])], names=["a", "b", "similarity"])

    t = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
    t = t.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
    return t.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """Least node of the component of each linked node: (uid, label), from links (a, b).

    Each round takes the least label among neighbours and then the label of that label, so rounds grow with the logarithm
    of a component's width. Rounds are stored tables; nothing is collected but the number of changes.
    """
    edges = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "uid"))
    while True:
        near = edges.join(labels, edges.b == labels.uid).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.uid == near.a).select("uid", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("uid").alias("low"), F.col("label").alias("high"))
        new = durable(step.join(up, "low", "left").select("uid", F.least("low", F.coalesce("high", "low")).alias("label"), F.col("label").alias("old")))
        if not new.filter("label <> old").limit(1).count():
            return new.select("uid", "label")
        labels = new.select("uid", "label")


def open_members(members: DataFrame, labels: DataFrame, sketches: DataFrame, whole: bool) -> DataFrame:
    """Members of buckets of three and more rows that hold several components, as (bucket, i, j, uid, label, side, sketch).

    Without ``whole`` each block of about BLOCK rows is compared with itself (side 2). With it, rows outside the bucket's
    largest component (side 0, in blocks i) are compared with all its rows (side 1, in blocks j); a bucket that is one
    large component and a few other rows thus costs about its own size.
    """
    m = members.join(labels, "uid", "left").select("bucket", "uid", F.coalesce("label", "uid").alias("label"))
    sizes = m.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    left = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("n > 2 AND parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    left = left.select("bucket", F.col("top.label").alias("top"), blocks(F.col("n")).alias("rows"), blocks(F.col("n") - F.col("top.n")).alias("others"))
    m = m.join(left, "bucket")
    block = lambda n: F.pmod(F.xxhash64("uid", "bucket"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    if whole:
        one = m.filter("label <> top").select("bucket", block("others").alias("i"), F.explode(every("rows")).alias("j"), "uid", "label", F.lit(0).alias("side"))
        m = one.unionByName(m.select("bucket", F.explode(every("others")).alias("i"), block("rows").alias("j"), "uid", "label", F.lit(1).alias("side")))
    else:
        m = m.select("bucket", block("rows").alias("i"), block("rows").alias("j"), "uid", "label", F.lit(2).alias("side"))
    return m.join(sketches, "uid").select("bucket", "i", "j", "uid", "label", "side", "sketch")


def _agreeing(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of the one side, the rows of the other in other components whose signatures agree with it, and how much."""
    uid, label, side = (t.column(c).to_numpy() for c in ("uid", "label", "side"))
    s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(uid), -1)
    for x in np.flatnonzero(side != 1):
        near = np.flatnonzero((side == 1 if side[x] == 0 else uid > uid[x]) & (label != label[x]))
        share = (s[near] == s[x]).mean(axis=1)
        hit = share >= AGREEMENT
        if hit.any():
            yield int(x), near[hit], share[hit]


def _joiner():
    """Union-find over labels: says whether two labels were apart, and joins them."""
    up: dict[int, int] = {}

    def find(k: int) -> int:
        while k in up:
            k = up[k]
        return k

    def join(a: int, b: int, only_look: bool = False) -> bool:
        a, b = find(a), find(b)
        if a != b and not only_look:
            up[max(a, b)] = min(a, b)
        return a != b

    return join


def likely_pairs(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) that would join the components of a block, those of the best agreeing signatures: fewer than its rows."""

    def forest(t: pa.Table) -> pa.Table:
        uid, label, join = t.column("uid").to_numpy(), t.column("label").to_pylist(), _joiner()
        pairs = sorted((-share, x, y) for x, near, shares in _agreeing(t) for y, share in zip(near.tolist(), shares.tolist(), strict=True))
        kept = [(uid[x], uid[y]) for _, x, y in pairs if join(label[x], label[y])]
        return pa.table({"a": pa.array([min(p) for p in kept], type=pa.int64()), "b": pa.array([max(p) for p in kept], type=pa.int64())})

    m = open_members(members, labels, sketches, whole=False)
    return m.groupBy("bucket", "i", "j").applyInArrow(forest, "a long, b long").distinct()


def remaining_links(members: DataFrame, labels: DataFrame, sketches: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components, by the whole comparison of the buckets that still hold several.

    Rows whose signature agrees with none of another component are left out first; those that remain bring their shingles,
    and a task gives only links that join components, so a block gives fewer links than it has rows.
    """

    def partners(t: pa.Table) -> pa.Table:
        own = sorted({k for x, near, _ in _agreeing(t) for k in (x, *near.tolist())})
        return t.take(pa.array(own, type=pa.int64()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in pieces(raw, 1 << 20):
                doc, h, _ = shingles(raw[a:b])
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(a, b - a), pa.array([h[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)], type=pa.binary())], names=["uid", "shingles"])

    def exact(t: pa.Table) -> pa.Table:
        uid, label, join = t.column("uid").to_numpy(), t.column("label").to_pylist(), _joiner()
        own = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
        kept = []
        for x, near, _ in _agreeing(t):
            for y in near.tolist():
                if join(label[x], label[y], only_look=True):
                    common = len(np.intersect1d(own[x], own[y], assume_unique=True))
                    if common >= least * (len(own[x]) + len(own[y]) - common):
                        join(label[x], label[y])
                        kept.append((uid[x], uid[y]))
        return pa.table({"a": pa.array([min(p) for p in kept], type=pa.int64()), "b": pa.array([max(p) for p in kept], type=pa.int64())})

    schema = "bucket long, i int, j int, uid long, label long, side int, sketch binary"
    m = open_members(members, labels, sketches, whole=True)
    m = durable(m.groupBy("bucket", "i", "j").applyInArrow(partners, schema))
    known = durable(texts.join(m.select("uid").distinct(), "uid", "left_semi").mapInArrow(sets, "uid long, shingles binary"))
    return m.join(known, "uid").groupBy("bucket", "i", "j").applyInArrow(exact, "a long, b long").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """Each row's class of near duplicates, a stored table: uid, doc_id, digest, label.

    Equal texts are one class from the start and are represented once. Representatives that share a band are verified
    against the least one of the bucket, which gives nearly all links; buckets that still hold several components are
    compared in blocks, first by their likeliest pairs and then in whole. Missing texts are empty ones, texts without words are near nothing but each other.
    """
    rows = signed(docs, counted)
    first = durable(rows.groupBy("digest").agg(F.min("uid").alias("uid")))
    reps = durable(rows.select("uid", "digest", "bands", "sketch").join(first.select("uid"), "uid", "left_semi"))
    banded = reps.select(F.explode("bands").alias("bucket"), "uid")
    shared = banded.groupBy("bucket").agg(F.min("uid").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = durable(banded.join(shared.select("bucket", "hub"), "bucket"))
    known = reps.select("uid", "digest").join(members.select("uid").distinct(), "uid", "left_semi")
    # the hint keeps one plan for all sizes
    text = docs.select(digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text")).join(durable(known).hint("merge"), "digest").groupBy("uid").agg(F.first("text").alias("text"))
    texts = durable(text)
    links = durable(verified(members.filter("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct(), texts, least))
    labels = components(links)
    sketches = reps.select("uid", "sketch")
    for more in (
        lambda: verified(likely_pairs(members, labels, sketches), texts, least),
        lambda: remaining_links(members, labels, sketches, texts, least),
    ):
        found = durable(more().select("a", "b"))
        if found.limit(1).count():
            links = durable(links.select("a", "b").unionByName(found))
            labels = components(links)
    label = first.join(labels, "uid", "left").select("digest", F.coalesce("label", "uid").alias("label"))
    return durable(rows.select("uid", "doc_id", "digest").join(label, "digest"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """doc_id, class_id (least document id of the class) and class_size of each row."""
    c = classes(docs, least, counted)
    each = durable(c.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return c.join(each, "label").select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame, least: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """One row of each class, that of the least document id (a missing one comes last), with all its columns."""
    c = classes(docs.select("doc_id", "text"), least, counted)
    best = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest"))
    kept = c.groupBy("label").agg(F.min_by("digest", best()).alias("digest")).select("digest")
    rows = docs.select(as_row(docs), digest().alias("digest"))
    rows = rows.groupBy("digest").agg(F.min_by("row", F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"))).alias("row"))
    return rows.join(durable(kept), "digest", "left_semi").select("row.*")
