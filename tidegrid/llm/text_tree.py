"""Language-model scoring by context-tree weighting over the running text of a document: contexts cross its blanks."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import pieces, remainder
from tidegrid.llm.language_model import HELD_OUT, log_estimate, log_gamma, tokens
from tidegrid.session import durable

#: Bytes of context, whatever words they belong to; before a text stand blanks.
DEPTH = 6
#: Documents are counted in runs of so many bytes, each with its own pairs and words. Positions that are looked at together.
CHUNK_BYTES, SLICE = 16 << 20, 1 << 20
#: Buckets of words by their hash.
WORD_BUCKETS = 1024
#: A context is hot if its stored pairs are more than both this number and this share of all: its pairs are split by one byte more.
#: So hot contexts are at most 1 / HOT_SHARE at each depth, and no task must hold more of the pairs than that.
HOT_PAIRS, HOT_SHARE = 1 << 19, 1 / 1024
#: Kinds of stored rows.
DOCUMENT, PAIRS, WORDS = 0, 1, 2


def running(words: list[bytes]) -> bytes:
    """The text that is scored: each token and a blank, the end (an empty word) included."""
    return b" ".join(words) + b" "


def owners(start: np.ndarray, a: int, b: int) -> np.ndarray:
    """For the positions from ``a`` to before ``b`` the index of the text each lies in."""
    first, last = np.searchsorted(start, [a, b - 1], side="right") - 1
    edges = np.clip(np.append(start[first : last + 1], b), a, b)
    return np.repeat(np.arange(first, last + 1), np.diff(edges))


def keys(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each byte of each text a 56-bit key, and the text's index: the DEPTH bytes before it, the nearest one highest, above the byte itself."""
    pad = b" " * DEPTH
    data = np.frombuffer(pad.join([b"", *texts]), dtype=np.uint8)
    # the eight bytes from each position on as one number
    ahead = np.ndarray(max(len(data) - DEPTH, 0), dtype="<i8", buffer=data.tobytes() + bytes(2), strides=(1,))
    size = np.fromiter((DEPTH + len(t) for t in texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(size) - size
    told = np.ones(len(data), dtype=bool)
    for k in range(DEPTH):
        told[start + k] = False
    for a in range(DEPTH, len(data), SLICE):
        b = min(len(data), a + SLICE)
        key = (ahead[a - DEPTH : b - DEPTH] & (1 << 8 * DEPTH) - 1) << 8 | data[a:b]
        keep = told[a:b]
        yield key[keep], owners(start, a, b)[keep]


def context(key: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes nearest to the byte of each key."""
    return key >> 8 * (DEPTH - depth + 1)


def cells(key: np.ndarray, hot: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each key the depth at which its subtree is cut off (the least one whose context is not hot) and the least context below that."""
    depth = np.full(len(key), 2)
    for d, known in hot.items():
        depth[np.isin(context(key, d), known)] = d + 1
    shift = 8 * (DEPTH - depth)
    return depth, key >> 8 >> shift << shift


def packed(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, deflated."""
    return zlib.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def firsts(x: np.ndarray) -> np.ndarray:
    """Where each value first stands in a sorted array."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def merged(key: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    x = np.concatenate([np.empty(0, dtype=np.int64), *key])
    order = np.argsort(x, kind="stable")
    x = x[order]
    first = firsts(x)
    x = x[first]
    weights = np.concatenate([np.empty(0, dtype=np.int64), *n])[order]
    return x, np.add.reduceat(weights, first) if len(x) else weights


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and where each value stands among them; quick on a few sorted runs."""
    order = np.argsort(x, kind="stable")
    run = x[order]
    new = np.diff(run, prepend=-1) != 0
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return run[new], inverse


def counted(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of each have ``counts`` set: one sort of the keys with that bit below them."""
    x = key << 1
    x |= counts
    x.sort()
    first = firsts(x >> 1)
    return x[first] >> 1, np.add.reduceat(x & 1, first) if len(x) else x


class Words:
    """The tokens of running texts (the end of each included) as codes of distinct words. Each token ends with the next blank."""

    def __init__(self, texts: list[bytes]):
        sizes, coded = [], []
        for a, b in pieces(texts):
            data = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
            blank = data == 32
            ends = np.flatnonzero(blank)
            upto = np.cumsum(np.fromiter(map(len, texts[a:b]), dtype=np.int64, count=b - a))
            sizes.append(np.diff(np.searchsorted(ends, upto), prepend=0))
            offsets = np.append(0, ends - np.arange(len(ends)))
            own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])])
            coded.append(own.dictionary_encode())
        self.size = np.concatenate(sizes)
        whole = pa.chunked_array(coded).unify_dictionaries()
        self.words: pa.Array = whole.chunk(0).dictionary
        self.code = np.concatenate([np.asarray(c.indices) for c in whole.chunks])


def bucketed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the words by bucket and then by themselves, the buckets that hold any, and where each begins in that order."""
    bucket = np.fromiter(map(zlib.crc32, words.to_pylist()), dtype=np.int64, count=len(words)) % WORD_BUCKETS
    order = pc.sort_indices(words).to_numpy()
    order = order[np.argsort(bucket[order], kind="stable")]
    first = firsts(bucket[order])
    return order, bucket[order][first], first


def stored(docs: DataFrame) -> DataFrame:
    """A stored table of three kinds of rows of each chunk: its documents (text deflated), its pairs by bucket and its words by bucket.

    Pairs and words have their counts in the training documents of the chunk; those of held-out documents alone have 0.
    """
    types = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("bucket", pa.int64()), ("size", pa.int64()), ("body", pa.binary()), ("n", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types.types)], schema=types)

    def chunk_rows(chunk: int, own: list[tuple]) -> Iterator[tuple]:
        texts, held = [t for _, _, t in own], np.array([h for _, h, _ in own])
        parts: tuple[list, list] = ([], [])
        for key, doc in keys(texts):
            for p, x in zip(parts, counted(key, ~held[doc]), strict=True):
                p.append(x)
            if sum(map(len, parts[0][1:])) > SLICE:
                parts = tuple([x] for x in merged(*parts))
        key, n = merged(*parts)
        del parts
        yield from ((chunk, DOCUMENT, i, h, None, None, zlib.compress(t, 1), None) for i, h, t in own)
        bucket = context(key, 2)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
            yield chunk, PAIRS, None, None, int(bucket[a]), b - a, packed(np.diff(key[a:b], prepend=0)), packed(n[a:b])
        told = Words(texts)
        bag = np.bincount(told.code, weights=np.repeat(~held, told.size), minlength=len(told.words)).astype(np.int64)
        order, buckets, first = bucketed(told.words)
        words, bag = told.words.take(pa.array(order)).to_pylist(), bag[order]
        for k, a, b in zip(buckets.tolist(), first.tolist(), [*first[1:].tolist(), len(words)], strict=True):
            yield chunk, WORDS, None, None, k, None, zlib.compress(b" ".join(words[a:b]), 1), packed(bag[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        own: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for r in chunk_rows(part << 32 | k, own):
                rows.append(r)
                if len(rows) == 500:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

        for batch in (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200)):
            for doc, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own.append((doc, held, running(tokens(text))))
                size += len(own[-1][2])
                if size >= CHUNK_BYTES:
                    yield from flush()
                    own, k, size = [], k + 1, 0
        if own:
            yield from flush()

    n, r = HELD_OUT
    d = docs.select("doc_id", (remainder(F.col("doc_id"), n) == r).alias("held_out"), "text")
    return durable(d.mapInArrow(run, "chunk long, kind int, doc_id long, held_out boolean, bucket long, size long, body binary, n binary"))


_WHOLE = 4096
_GAMMA_HALF, _GAMMA_ONE = log_gamma(np.arange(_WHOLE) + 0.5), log_gamma(np.arange(2 * _WHOLE) + 1.0)


def estimates(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``log_estimate`` of whole counts, those of small ones from a table."""
    out = np.empty(len(zeros))
    small = (zeros < _WHOLE) & (ones < _WHOLE)
    a, b = zeros[small].astype(np.int64), ones[small].astype(np.int64)
    out[small] = _GAMMA_HALF[a] + _GAMMA_HALF[b] - _GAMMA_ONE[a + b] - math.log(math.pi)
    out[~small] = log_estimate(zeros[~small], ones[~small])
    return out


class Subtree:
    """Weighted nodes of the contexts from DEPTH down to ``root`` bytes over whole subtrees of sorted distinct keys.

    A node is a context with the first bits of the byte. At each depth the distinct (context, byte) rows lie in order, so the nodes
    of every bit position are runs of rows.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, root: int):
        self.root, self.rows = root, [(key, n, None)]
        for _ in range(DEPTH - root):
            k, m, _ = self.rows[-1]
            short, up = distinct((k >> 16) << 8 | k & 255)
            self.rows.append((short, np.bincount(up, weights=m, minlength=len(short)), up))

    def nodes(self, position: int) -> list[tuple[np.ndarray, ...]]:
        """For each depth, the longest first: bit and node of each row, and first row, zeros, ones, ln of own and weighted probability of each node."""
        out: list[tuple[np.ndarray, ...]] = []
        for k, m, up in self.rows:
            new = np.diff(k >> (8 - position), prepend=-1) != 0
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            bit = k >> (7 - position) & 1
            one = np.bincount(node, weights=m * bit, minlength=len(first))
            zero = np.bincount(node, weights=m * (1 - bit), minlength=len(first))
            own = weighted = estimates(zero, one)
            if out:
                below = np.bincount(node[up[out[-1][2]]], weights=out[-1][6], minlength=len(first))
                weighted = np.logaddexp(own, below) - math.log(2)
            out.append((bit, node, first, zero, one, own, weighted))
        return out

    def scores(self, top: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """log10 probability of the byte of each key. ``top``: for each depth from 0 on, hot contexts in order and their nodes' weights, zeros and ones."""
        total = np.zeros(len(self.rows[0][0]))
        k = self.rows[-1][0]
        above = [np.searchsorted(top[d][0], k >> 8 * (self.root - d + 1)) for d in range(self.root)]
        for position in range(8):
            levels = self.nodes(position)
            node = 1 << position | (k & 255) >> (8 - position)
            mixed, rest = np.zeros(len(k)), np.ones(len(k))
            bit = levels[-1][0]
            parts = []
            for (_, weight, zeros, ones), row in zip(top, above):
                a, b = zeros[row, node], ones[row, node]
                parts.append((weight[row, node], (np.where(bit == 1, b, a) + 0.5) / (a + b + 1.0)))
            for w, p in parts:
                mixed, rest = mixed + rest * w * p, rest * (1 - w)
            for depth in range(len(levels) - 1, -1, -1):
                bit, node, _, a, b, own, weighted = levels[depth]
                w = 0.5 * np.exp(np.minimum(math.log(2), own - weighted)) if depth else np.ones(len(own))
                hit = np.where(bit == 1, b[node], a[node]) + 0.5
                mixed, rest = mixed + rest * w[node] * hit / (a + b + 1.0)[node], rest * (1 - w[node])
                if depth:
                    up = self.rows[depth][2]
                    mixed, rest = mixed[up], rest[up]
            total += np.log10(mixed)
        return total


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], Subtree]]:
    """Runs of whole cells of one depth from rows in order, of about SLICE stored pairs: their (chunk, bucket, body) rows, and the subtrees of their distinct keys."""
    rows, key, n = [], [], []
    size = held = 0
    last = (-1, -1)

    def closed() -> tuple[list[tuple], Subtree]:
        return rows, Subtree(*merged(key, n), last[0])

    for batch in batches:
        for depth, bucket, chunk, body, count in zip(*(batch.column(c).to_pylist() for c in ("depth", "bucket", "chunk", "body", "n")), strict=True):
            if rows and (depth, bucket) != last and (depth != last[0] or size > SLICE // 2):
                yield closed()
                rows, key, n, size, held = [], [], [], 0, 0
            last = depth, bucket
            rows.append((chunk, bucket, body))
            key.append(np.cumsum(unpacked(body)))
            n.append(unpacked(count))
            size, held = size + len(key[-1]), held + len(key[-1])
            if held > 2 * SLICE + 2 * len(key[0]):
                k, m = merged(key, n)
                key, n, held = [k], [m], len(k)
    if rows:
        yield closed()


def hot_contexts(pairs: DataFrame) -> dict[int, np.ndarray]:
    """Hot contexts by depth from 2 on, in order; those of the full depth can't be split. At most 1 / HOT_SHARE a depth, whatever the corpus."""
    total = pairs.agg(F.sum("size").alias("n")).first().n or 0
    bound = max(HOT_PAIRS, int(total * HOT_SHARE))
    hot: dict[int, np.ndarray] = {}
    sizes = pairs.groupBy("bucket").agg(F.sum("size").alias("size"))
    for depth in range(2, DEPTH):
        found = sizes.filter(F.col("size") > bound).select("bucket").collect()
        if not found:
            break
        hot[depth] = known = np.sort(np.array([r.bucket for r in found]))

        def below(batches: Iterator[pa.RecordBatch], depth: int = depth, known: np.ndarray = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column("body").to_pylist():
                    key = np.cumsum(unpacked(body))
                    c = context(key[np.isin(context(key, depth), known)], depth + 1)
                    first = np.flatnonzero(np.diff(c, prepend=-1))
                    yield pa.RecordBatch.from_arrays([pa.array(c[first]), pa.array(np.diff(first, append=len(c)))], names=["bucket", "size"])

        own = pairs.filter(F.col("bucket").isin(hot[2].tolist())).select("body")
        sizes = own.mapInArrow(below, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
    return hot


def in_cells(pairs: DataFrame, hot: dict[int, np.ndarray]) -> DataFrame:
    """Pairs by cell, in order inside their partitions: depth, bucket (the cell's least context), chunk, body, n. Rows of hot buckets are split."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body, count in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body", "n")), strict=True):
                key, n = np.cumsum(unpacked(body)), unpacked(count)
                depth, least = cells(key, hot)
                first = np.flatnonzero(np.diff(least, prepend=-1))
                ends = [*first[1:].tolist(), len(key)]
                bodies = [packed(np.diff(key[a:b], prepend=0)) for a, b in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(depth[first]), pa.array(least[first]), pa.array([chunk] * len(first), type=pa.int64()), pa.array(bodies, type=pa.binary()), pa.array([packed(n[a:b]) for a, b in zip(first, ends, strict=True)], type=pa.binary())],
                    names=["depth", "bucket", "chunk", "body", "n"],
                )

    is_hot = F.col("bucket").isin(hot[2].tolist()) if hot else F.lit(False)
    out = pairs.filter(~is_hot).select(F.lit(2).cast("long").alias("depth"), F.shiftleft("bucket", 8 * (DEPTH - 2)).alias("bucket"), "chunk", "body", "n")
    if hot:
        parts = pairs.filter(is_hot).select("chunk", "body", "n")
        out = out.unionByName(parts.mapInArrow(split, "depth long, bucket long, chunk long, body binary, n binary"))
    return out.repartition("depth", "bucket").sortWithinPartitions("depth", "bucket")


def top_tables(pairs: DataFrame, hot: dict[int, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """For each depth from 0 on the hot contexts (of one byte and of none: all) with the weights, zeros and ones of their nodes.

    Tasks sum the nodes of their cells by the context one byte shorter, so what reaches the driver is bounded by the number of hot contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tree in _subtrees(batches):
            for position in range(8):
                _, _, first, zeros, ones, _, weighted = tree.nodes(position)[-1]
                k = tree.rows[-1][0][first]
                at, up = distinct(k >> 16 << 8 | 1 << position | (k & 255) >> (8 - position))
                sums = [pa.array(np.bincount(up, weights=x, minlength=len(at))) for x in (zeros, ones, weighted)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree.root - 1)), pa.array(at), *sums], names=["depth", "node", "zeros", "ones", "below"])

    names = ("zeros", "ones", "below")
    found = pairs.mapInArrow(run, "depth long, node long, zeros double, ones double, below double")
    found = found.groupBy("depth", "node").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    depth, at = (found.column(c).to_numpy() for c in ("depth", "node"))
    told = [found.column(c).to_numpy() for c in names]
    known = {0: np.zeros(1, dtype=np.int64), 1: np.arange(256), **hot}
    sums = {d: np.zeros((3, len(c), 256)) for d, c in known.items()}
    tables = []
    for d in sorted(known, reverse=True):
        own = depth == d
        row = np.searchsorted(known[d], at[own] >> 8)
        for s, x in zip(sums[d], told, strict=True):
            s[row, at[own] & 255] += x[own]
        zeros, ones, below = sums[d]
        kt = log_estimate(zeros, ones)
        weighted = np.logaddexp(kt, below) - math.log(2)
        tables.append((known[d], 0.5 * np.exp(kt - weighted), zeros, ones))
        if d:
            for s, x in zip(sums[d - 1], (zeros, ones, weighted), strict=True):
                np.add.at(s, np.searchsorted(known[d - 1], known[d] >> 8), x)
    return tables[::-1]


def pair_scores(rows: DataFrame) -> DataFrame:
    """log10 probabilities of the pairs of each chunk and cell in their order, as 32-bit floats: (chunk, kind, bucket, body)."""
    pairs = rows.filter(F.col("kind") == PAIRS).select("chunk", "bucket", "size", "body", "n")
    hot = hot_contexts(pairs)
    pairs = in_cells(pairs, hot)
    top = top_tables(pairs, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, tree in _subtrees(batches):
            key, score = tree.rows[0][0], tree.scores(top).astype(np.float32)
            for a in range(0, len(own), 500):
                part = own[a : a + 500]
                body = [score[np.searchsorted(key, np.cumsum(unpacked(b)))].tobytes() for _, _, b in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], type=pa.int64()), pa.array([PAIRS] * len(part), type=pa.int32()), pa.array([r[1] for r in part], type=pa.int64()), pa.array(body, type=pa.binary())],
                    names=["chunk", "kind", "bucket", "body"],
                )

    return pairs.mapInArrow(run, "chunk long, kind int, bucket long, body binary")


def word_counts(rows: DataFrame) -> DataFrame:
    """Training counts of the words of each chunk and bucket in their order, a stored table; total and v are the bucket's tokens and words, told once."""

    def told(t: pa.Table) -> pa.Table:
        lists = [zlib.decompress(b).split(b" ") for b in t.column("body").to_pylist()]
        total: Counter = Counter()
        for words, n in zip(lists, t.column("n").to_pylist(), strict=True):
            for w, x in zip(words, unpacked(n).tolist(), strict=True):
                total[w] += x
        m = len(lists) - 1
        return pa.table({
            "chunk": t.column("chunk"), "kind": pa.array([WORDS] * (m + 1), type=pa.int32()), "bucket": t.column("bucket"), "body": pa.array([packed(np.array([total[w] for w in words])) for words in lists], type=pa.binary()),
            "total": pa.array([sum(total.values())] + [0] * m, type=pa.int64()), "v": pa.array([sum(x > 0 for x in total.values())] + [0] * m, type=pa.int64()),
        })

    words = rows.filter(F.col("kind") == WORDS).select("chunk", "bucket", "body", "n")
    return durable(words.groupBy("bucket").applyInArrow(told, "chunk long, kind int, bucket long, body binary, total long, v long"))


def scored(docs: DataFrame) -> DataFrame:
    """Scores of each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows whose crc32 of the id modulo 7 is not 2. ``base_score`` is the add-one word model; ``score`` is the
    log10 probability of the running text, its words each followed by a blank and then the end (an empty word), under a
    weighted context tree of the DEPTH bytes before each byte; ``bits_per_byte`` is its code length. A missing text is an
    empty one. Without training rows all estimates are one half.
    """
    rows = stored(docs)
    words = word_counts(rows)
    total = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_train, least = int(total.n), math.log10(total.n + total.v + 1)
    dictionary = pair_scores(rows).unionByName(words.select("chunk", "kind", "bucket", "body"))
    own = rows.filter(F.col("kind") == DOCUMENT).select(F.col("chunk").alias("home"), "doc_id", "held_out", "body")

    def told(d: pa.Table, w: pa.Table) -> pa.Table:
        texts = [zlib.decompress(b) for b in d.column("body").to_pylist()]
        kind, bucket, body = (w.column(c).to_pylist() for c in ("kind", "bucket", "body"))
        score = np.concatenate([np.frombuffer(b, dtype=np.float32) for _, b in sorted((k, b) for x, k, b in zip(kind, bucket, body, strict=True) if x == PAIRS)])
        counts = {k: unpacked(b) for x, k, b in zip(kind, bucket, body, strict=True) if x == WORDS}
        # the keys are made twice, so that a chunk holds its distinct ones only
        pairs = np.empty(0, dtype=np.int64)
        for key, _ in keys(texts):
            key.sort()
            pairs = np.concatenate([pairs, key[firsts(key)]])
            pairs.sort(kind="stable")
            pairs = pairs[firsts(pairs)]
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        sums = np.zeros(len(texts))
        for key, doc in keys(texts):
            order = np.argsort(key)
            key = key[order]
            first = firsts(key)
            own_score = np.empty(len(key))
            own_score[order] = np.repeat(score[np.searchsorted(pairs, key[first])], np.diff(first, append=len(key)))
            sums += np.bincount(doc, weights=own_score, minlength=len(texts))
        del pairs, score
        words = Words(texts)
        order, buckets, _ = bucketed(words.words)
        count = np.empty(len(order), dtype=np.int64)
        count[order] = np.concatenate([counts[k] for k in buckets.tolist()])
        doc = np.repeat(np.arange(len(texts)), words.size)
        n_known, base = (np.bincount(doc, weights=x, minlength=len(texts)) for x in ((count > 0)[words.code], (np.log10(count + 1) - least)[words.code]))
        long_, double = (lambda x: pa.array(x, type=pa.int64())), (lambda x: pa.array(x, type=pa.float64()))
        return pa.table({"doc_id": d.column("doc_id"), "held_out": d.column("held_out"), "n_tokens": long_(words.size), "n_known": long_(n_known.astype(np.int64)), "train_tokens": long_([n_train] * len(d)), "base_score": double(base), "score": double(sums), "bits_per_byte": double(-sums * math.log2(10) / size)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return own.groupBy("home").cogroup(dictionary.groupBy("chunk")).applyInArrow(told, schema)
