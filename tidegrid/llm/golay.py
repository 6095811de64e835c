"""SimHash near duplicates: fingerprints, Golay-code keys of their segments, joined buckets, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import joined, pieces, word_ranges
from tidegrid.llm.minhash import components
from tidegrid.session import durable

WORDS, SEED, RADIUS = 4, 42, 4
#: Lengths of the three segments of a fingerprint, low bits first; each fits a word of the code.
SEGMENTS = (22, 21, 21)
#: Length and dimension of the perfect binary Golay code, and its generator polynomial.
LENGTH, DIMENSION, GENERATOR = 23, 12, 0b110001110101
#: Fingerprints that one bucket compares; larger buckets are cut by exact pieces, and then by midpoints.
LARGE = 4096


# --- fingerprints


@lru_cache(maxsize=1)
def _spread() -> np.ndarray:
    """The 8 bits of each byte as 8 counters of a byte."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of hashes: runs begin at ``starts`` and are not empty."""
    ends = np.append(starts[1:], len(h))
    # byte counters hold 255 hashes, so runs are cut to at most that
    cuts = -(-(ends - starts) // 255)
    first = np.cumsum(cuts) - cuts
    at = np.repeat(starts - 255 * first, cuts) + 255 * np.arange(cuts.sum())
    counters = np.add.reduceat(_spread()[h.view(np.uint8)].reshape(-1, 8), at, axis=0)
    return np.add.reduceat(counters.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)


def shingle_hashes(text: bytes) -> bytes:
    """XXH64 (8 bytes each) of the word shingles of a text in order, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return b""
    data = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest, k = xxhash.xxh64_digest, min(WORDS, len(words)) - 1
    return b"".join([digest(data[a:b], SEED) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's shingle hashes; a text without words has zero. Bytes are split at ASCII white space only."""
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(x) // 8 for x in hashes], dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    own = np.flatnonzero(sizes)
    if len(own):
        h = np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64)
        n = sizes[own]
        over = 2 * bit_counts(h, np.cumsum(n) - n) > n[:, None]
        out[own] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """A stored table with a row for each row: doc_id, fp (the fingerprint's 64 bits as a signed number). A missing text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for a, b in pieces(texts, 1 << 20):
                fp = fingerprints(texts[a:b]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(fp)], names=["doc_id", "fp"])

    return durable(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long"))


# --- keys


def _remainder(v: np.ndarray) -> np.ndarray:
    """Remainders of binary polynomials of degree below LENGTH by the generator."""
    v = v.copy()
    for k in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        v ^= np.where(v >> k & 1, GENERATOR << (k - LENGTH + DIMENSION), 0)
    return v


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and the error of at most 3 bits that each syndrome stands for."""
    low, high = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)
    errors = np.array([sum(1 << k for k in c) for n in range(4) for c in combinations(range(LENGTH), n)])
    leader = np.zeros(1 << (LENGTH - DIMENSION), dtype=np.int64)
    leader[_remainder(errors)] = errors
    return low, high, leader


def decoded(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word; the code is perfect, so it is at most 3 bits away and unique."""
    low, high, leader = _tables()
    return (v ^ leader[low[v & 0xFFF] ^ high[v >> 12]]) >> (LENGTH - DIMENSION)


def segment_keys(v: np.ndarray, bits: int) -> np.ndarray:
    """The codeword indices of a segment and of all words one bit away from it, each once: (n, 6) with -1 where there are fewer.

    Two segments at most 2 bits apart have a word at most 1 bit from both, so they share an index.
    """
    flips = np.append(0, 1 << np.arange(bits))
    near = np.sort(decoded(v[:, None] ^ flips), axis=1)
    new = np.ones(near.shape, dtype=bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out = np.full((len(v), max(6, int(place.max(initial=0)) + 1)), -1, dtype=np.int64)
    row, col = np.nonzero(new)
    out[row, place[row, col]] = near[row, col]
    return out


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all keys: fingerprints at most RADIUS = 4 bits apart share one.

    Of the three segments' errors the least two sum to 2 at most, so both of those segments share an index; a key is a pair
    of segments with an index of each, 24 bits besides the pair.
    """
    segments, at = [], 0
    for bits in SEGMENTS:
        segments.append(segment_keys((fp >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1), bits))
        at += bits
    rows, keys = [], []
    for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        one, two = segments[i][:, :, None], segments[j][:, None, :]
        row, a, b = np.nonzero((one >= 0) & (two >= 0))
        rows.append(row)
        keys.append((k << 24) | (segments[i][row, a] << 12) | segments[j][row, b])
    return np.concatenate(rows), np.concatenate(keys)


def piece_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, key) of the RADIUS + 1 exact pieces of each fingerprint: one of them is without error."""
    edges = np.linspace(0, 64, RADIUS + 2).astype(int)
    keys = [(k << 16) | ((fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return np.tile(np.arange(len(fp)), len(keys)), np.concatenate(keys)


def midpoint_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, key) of all words at most RADIUS / 2 bits from each fingerprint, itself included.

    Fingerprints at most RADIUS bits apart share one, and all that share one are at most RADIUS apart: no verification.
    """
    flips = [sum(1 << k for k in c) for n in range(RADIUS // 2 + 1) for c in combinations(range(64), n)]
    keys = fp[:, None] ^ np.array(flips, dtype=np.uint64)
    return np.repeat(np.arange(len(fp)), len(flips)), keys.ravel().view(np.int64)


def keyed(rows: DataFrame, keys, bucket: str | None = None) -> DataFrame:
    """(bucket, fp) with a row for each key of each fp; ``bucket`` names a column whose value the key refines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few at a time, for a fingerprint may have thousands of keys
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                row, key = keys(fp)
                above = pa.array(part.column(bucket).to_numpy(zero_copy_only=False)[row]) if bucket else pa.array(np.zeros(len(row), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([above, pa.array(key), pa.array(fp[row].view(np.int64))], names=["above", "key", "fp"])

    return rows.select("fp", *([bucket] if bucket else [])).mapInArrow(run, "above long, key long, fp long")


# --- buckets


def links_inside(bucket: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that join all rows of equal bucket at most ``radius`` bits apart: a forest, not all pairs. Rows are sorted by bucket."""
    n = len(fp)
    root, found = np.arange(n), []

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return int(k)

    # rows at distance d in the order, for all buckets at once
    left = np.arange(n - 1)
    d = 1
    while True:
        left = left[left + d < n]
        left = left[bucket[left] == bucket[left + d]]
        if not len(left):
            return found
        apart = left[root[left] != root[left + d]]
        hit = apart[np.bitwise_count(fp[apart] ^ fp[apart + d]) <= radius]
        for x in hit.tolist():
            a, b = find(x), find(x + d)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((x, x + d))
        if len(hit):
            while (root[root] != root).any():
                root = root[root]
        d += 1


def bucket_links(members: DataFrame) -> DataFrame:
    """Links (a, b) of the buckets of ``members`` (bucket, fp), each of at most LARGE rows: fewer than there are rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def linked(upto: int) -> pa.RecordBatch:
            pairs = np.array(links_inside(bucket[:upto], fp[:upto]), dtype=np.int64).reshape(-1, 2)
            ends = fp[pairs].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])

        for batch in batches:
            bucket = np.append(bucket, batch.column("bucket").to_numpy(zero_copy_only=False))
            fp = np.append(fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            # the last bucket may go on in the next batch
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if whole:
                yield linked(whole)
                bucket, fp = bucket[whole:], fp[whole:]
        if len(bucket):
            yield linked(len(bucket))

    return members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def parted(members: DataFrame, large: int) -> tuple[DataFrame, DataFrame | None]:
    """Links of the buckets of at most ``large`` rows, and a stored table (bucket, fp) of the rows of larger ones (None if there are none).

    Buckets are counted before their rows are brought together, so no task receives a large one.
    """
    d = members.select(F.xxhash64("above", "key").alias("bucket"), "fp")
    over = durable(d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("bucket"))
    if not over.limit(1).count():
        return bucket_links(d), None
    return bucket_links(d.join(over, "bucket", "left_anti")), durable(d.join(over, "bucket", "left_semi"))


def midpoint_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints by their midpoints: no two are compared, and no key holds more than 2,081 of them."""
    d = keyed(rows, midpoint_keys).select("key", "fp")
    hub = d.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").select("key", "a")
    return d.join(hub, "key").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def all_links(distinct: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints at most RADIUS bits apart.

    Buckets of Golay keys hold up to ``large`` rows. Larger ones are cut by exact pieces into smaller buckets; fingerprints of
    those that stay larger are looked up by their midpoints, at a cost in proportion to their number. Nothing is left out.
    """
    links, rest = parted(keyed(distinct, golay_keys), large)
    found = [links]
    if rest is not None:
        links, clumps = parted(keyed(rest, piece_keys, "bucket"), large)
        found.append(links)
        if clumps is not None:
            found.append(midpoint_links(clumps.select("fp").distinct()))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return durable(links.distinct())


def near_duplicates(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row of (doc_id, text).

    Rows are linked where fingerprints differ in at most 4 bits; ``component_id`` is the least document id that is reached by
    links. Equal fingerprints are one from the start, so copies are never paired. A missing text is an empty one: its
    fingerprint is zero, which links like any other. Repeated rows come out as often as they go in; missing ids are passed
    over for the least one, and a component of missing ids alone has none.
    """
    rows = fingerprinted(docs)
    least = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(all_links(least.select("fp"), large))
    each = least.join(labels.withColumnRenamed("uid", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    each = durable(each)
    ids = each.groupBy("label").agg(F.min("least").alias("component_id"))
    known = durable(each.select("fp", "label").join(ids, "label").select("fp", "component_id"))
    return rows.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
