"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import joined, mix, pieces, remainder, token_hashes
from tidegrid.session import durable

#: Words are hashed into so many rows, so the word vectors are a table of fixed size (4 MB) however large the corpus is.
ROWS, DIMS = 1 << 15, 32
#: Entries that are not 0 in a word's index vector, and words that count as context on each side.
ENTRIES, REACH = 2, 2
BLOCK = 64
#: At most so many labelled rows train the network.
TRAIN_ROWS = 40_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 30, 256, 3e-3
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    """Groups of bytes that stay together in a word: letters and bytes above 127, digits, line feeds, and each other sign by itself; 0 is blank."""
    kinds = np.arange(256, dtype=np.uint8) + 0
    kinds[[9, 11, 12, 13, 32]] = 0
    kinds[48:58] = 48
    kinds[65:91] = kinds[97:123] = kinds[128:] = 97
    return kinds


KINDS = _kinds()


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each word row, the places and signs of the entries of its index vector."""
    h = mix(np.arange(ROWS * ENTRIES, dtype=np.uint64) + np.uint64(1)).reshape(ROWS, ENTRIES)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.int64)


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of all texts in order, and the index of each word's text."""
    data, starts = joined(texts)
    kind = KINDS[data]
    kind[np.append(starts[1:], len(data)) - 1] = 0
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    first, last = change[:-1], change[1:]
    own = kind[first] != 0 if len(first) else np.empty(0, dtype=bool)
    first, last = first[own], last[own]
    rows = (token_hashes(data, first, last) % np.uint64(ROWS)).astype(np.int64)
    return rows, np.searchsorted(starts, first, side="right") - 1


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def context_sums(docs: DataFrame) -> np.ndarray:
    """Word rows times dimensions: sums of the index vectors of a word and of the words around it, over all documents.

    A task adds its documents into one matrix and sends it in blocks of rows; blocks are added in two steps, so no group
    holds more than 256 of them. The result is the fixed-size table, on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        acc = np.zeros(ROWS * DIMS, dtype=np.int64)
        for batch in batches:
            texts = _texts(batch)
            for a, b in pieces(texts):
                rows, doc = word_rows(texts[a:b])
                for shift in range(-REACH, REACH + 1):
                    here = slice(max(0, -shift), len(rows) - max(0, shift))
                    there = slice(max(0, shift), len(rows) + min(0, shift))
                    same = doc[here] == doc[there]
                    word, other = rows[here][same] * DIMS, rows[there][same]
                    for k in range(ENTRIES):
                        np.add.at(acc, word + place[other, k], sign[other, k])
        parts = acc.reshape(-1, BLOCK * DIMS)
        used = np.flatnonzero(parts.any(axis=1))
        salt = TaskContext.get().partitionId() >> 8
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), salt)), pa.array([parts[k].tobytes() for k in used], type=pa.binary())], names=["block", "salt", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x, dtype=np.int64) for x in t.column("sums").to_pylist()), np.zeros(BLOCK * DIMS, dtype=np.int64))
        return pa.table({"block": t.column("block")[:1], "salt": t.column("salt")[:1], "sums": pa.array([total.tobytes()], type=pa.binary())})

    schema = "block long, salt long, sums binary"
    sums = docs.select("text").mapInArrow(run, schema).groupBy("block", "salt").applyInArrow(add, schema)
    sums = sums.groupBy("block").applyInArrow(add, schema)
    out = np.zeros((ROWS // BLOCK, BLOCK * DIMS))
    for r in sums.collect():
        out[r.block] = np.frombuffer(r.sums, dtype=np.int64)
    return out.reshape(ROWS, DIMS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Rows of length 1; what all words have in common is taken off first."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)
    mean = unit[size[:, 0] > 0].mean(axis=0) if size.any() else 0
    unit = np.where(size > 0, unit - mean, 0)
    size = np.linalg.norm(unit, axis=1, keepdims=True)
    return np.divide(unit, size, out=np.zeros_like(unit), where=size > 0).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and ``features`` of each row: mean and spread of its word vectors and the logarithm of its length, as 32-bit floats. Empty texts have zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = _texts(batch)
            out = np.zeros((len(texts), 2 * DIMS + 1), dtype=np.float32)
            for a, b in pieces(texts, 1 << 19):
                rows, doc = word_rows(texts[a:b])
                if not len(rows):
                    continue
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                n = np.diff(np.append(first, len(doc)))[:, None]
                v = table[rows]
                mean = np.add.reduceat(v, first, axis=0, dtype=np.float64) / n
                square = np.add.reduceat(v * v, first, axis=0, dtype=np.float64) / n
                out[a + doc[first]] = np.hstack([mean, np.sqrt(np.maximum(0, square - mean * mean)), np.log1p(n)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in out], type=pa.binary())], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features binary")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the cross entropy; a tenth of the rows is held back, and the temperature makes their probabilities likeliest.

    Without rows the probability is one half everywhere; with one class it goes to that class.
    """
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(x.mean(axis=0) if len(x) else np.zeros(d), x.std(axis=0) + 1e-3 if len(x) else np.ones(d), rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(x):
        return net
    order = rng.permutation(len(x))
    back, own = order[: len(x) // 10], order[len(x) // 10 :]
    z = (x - net.mean) / net.scale
    net.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    values = [net.w1, net.b1, net.w2, np.array(net.b2)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        own = rng.permutation(own)
        for k in range(0, len(own), BATCH):
            i = own[k : k + BATCH]
            pre = z[i] @ values[0] + values[1]
            hidden = np.maximum(0, pre)
            p = 1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -30, 30)))
            e = (p - y[i]) / len(i)
            back_e = np.outer(e, values[2]) * (pre > 0)
            step += 1
            for m, grad in enumerate((z[i].T @ back_e + 1e-4 * values[0], back_e.sum(axis=0), hidden.T @ e + 1e-4 * values[2], np.array(e.sum()))):
                first[m] = 0.9 * first[m] + 0.1 * grad
                second[m] = 0.999 * second[m] + 0.001 * grad * grad
                values[m] = values[m] - RATE * (first[m] / (1 - 0.9**step)) / (np.sqrt(second[m] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3])
    if len(back):
        logits, own_y = net.logits(x[back]), y[back]
        loss = lambda t: np.mean(np.logaddexp(0, np.where(own_y == 1, -logits, logits) / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 121), key=loss))
    return net


def training_rows(features: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about ``most`` labelled documents outside the held-out fifth, drawn by a hash of the id.

    Ids that are labelled twice take the larger label; missing ids and labels are left out.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = own.count()
    share = min(1.0, most / max(n, 1))
    own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = features.dropDuplicates(["doc_id"]).join(own, "doc_id").select("doc_id", "features", "quality").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r.features, dtype=np.float32) for r in rows], dtype=np.float64).reshape(-1, 2 * DIMS + 1)
    return x, np.array([float(r.quality) for r in rows])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; the text alone decides a score, so equal texts have equal ones."""
    vectors = word_vectors(context_sums(docs))
    features = durable(pooled(docs, vectors))
    net = train(*training_rows(features, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(f, dtype=np.float32) for f in batch.column("features").to_pylist()], dtype=np.float64).reshape(-1, 2 * DIMS + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.probabilities(x))], names=["doc_id", "score"])

    out = features.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
