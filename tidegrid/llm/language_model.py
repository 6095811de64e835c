"""Language-model scoring by context-tree weighting over the bits of a word's bytes."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import joined, remainder
from tidegrid.session import durable

#: Bytes of context: those of the word, the blank before it, and the sign of the document's opening, with which it ends.
DEPTH = 6
#: A document's opening is told by the commonest of so many short words (of at most SHORT bytes) among its first OPENING words, as far as they are read; it is looked at every STEP words.
SIGNS, SHORT, OPENING, STEP = 64, 4, 64, 8
#: The blank that ends a word, and stands before its first byte.
BLANK = 32
#: Documents are counted in runs, each with a dictionary of its own words; a run ends at so many bytes or words, which bounds a task's memory.
CHUNK_BYTES, CHUNK_WORDS = 32 << 20, 800_000
#: Words whose byte contexts are looked up together.
WORD_BLOCK = 250_000
HELD_OUT = (7, 2)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with ASCII letters in lower case, then one end, which is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def opening_words(docs: DataFrame) -> dict[bytes, int]:
    """The commonest short words of all training documents, with their ranks. Tasks count first; short words are few, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n.update(w for w in tokens(text) if 0 < len(w) <= SHORT)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), type=pa.binary()), pa.array(list(n.values()), type=pa.int64())], names=["word", "n"])

    counts = training(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): k for k, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(SIGNS).collect())}


def training(docs: DataFrame) -> DataFrame:
    n, r = HELD_OUT
    return docs.filter(remainder(F.col("doc_id"), n) != r)


def units(words: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Each token after the sign of its document's opening: a byte of 0 until a listed word was read, then one for the commonest read so far."""
    out, best = [], SIGNS
    for a in range(0, len(words), STEP):
        sign = bytes([0 if best == SIGNS else 64 + best])
        part = words[a : a + STEP] if a < OPENING else words[a:]
        out += [sign + w for w in part]
        if a >= OPENING:
            break
        best = min(best, min((ranks.get(w, SIGNS) for w in part), default=SIGNS))
    return out


def counted(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """A stored table of two kinds of rows: documents (their units as numbers with counts), and the units of each chunk with their training counts.

    A unit is a token with the sign of its document's opening. Columns: chunk, doc_id, held_out, n_tokens, ids (differences)
    and times (32-bit numbers, deflated; the document), number, word, n (in the training documents of the chunk). Chunks belong to the
    stored rows. Units of a chunk are at most its bytes.
    """
    schema = "chunk long, doc_id long, held_out boolean, n_tokens long, ids binary, times binary, number int, word binary, n long"
    types = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("times", pa.binary()), ("number", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        numbers: dict[bytes, int] = {}
        train: list[int] = []
        out: list[tuple] = []

        def documents() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            n = len(out)
            out.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(list(c), type=t) for c, t in zip(columns, types.types[:6], strict=True)], *[pa.nulls(n, t) for t in types.types[6:]]], schema=types)

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for a in range(0, len(words), 50_000):
                own = words[a : a + 50_000]
                m = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part << 32 | k)), *[pa.nulls(m, t) for t in types.types[1:6]], pa.array(np.arange(a, a + m, dtype=np.int32)), pa.array(own, type=pa.binary()), pa.array(train[a : a + m], type=pa.int64())],
                    schema=types,
                )

        rows = (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200))
        for batch in rows:
            for doc, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                bag = Counter(units(tokens(text), ranks))
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in bag), dtype=np.uint32, count=len(bag))
                train += [0] * (len(numbers) - len(train))
                if not held:
                    for number, n in zip(ids.tolist(), bag.values(), strict=True):
                        train[number] += n
                times = np.fromiter(bag.values(), dtype=np.uint32, count=len(bag))
                order = np.argsort(ids)
                out.append((part << 32 | k, doc, held, int(times.sum()), *(zlib.compress(x.tobytes(), 1) for x in (np.diff(ids[order], prepend=np.uint32(0)), times[order]))))
                size += len(text or "")
                if len(out) >= 500:
                    yield documents()
                if size >= CHUNK_BYTES or len(numbers) >= CHUNK_WORDS:
                    yield documents()
                    yield from dictionary()
                    numbers, train, k, size = {}, [], k + 1, 0
        yield documents()
        yield from dictionary()

    n, r = HELD_OUT
    d = docs.select("doc_id", (remainder(F.col("doc_id"), n) == r).alias("held_out"), "text")
    return durable(d.mapInArrow(run, schema))


def contexts(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each unit's word and its ending blank: the context of DEPTH bytes (nearest one lowest) above the byte itself, and the unit's index."""
    size = np.fromiter((len(w) + 2 for w in own), dtype=np.int64, count=len(own))
    data, start = joined([w[:1] + b" " + w[1:] for w in own])
    word = np.repeat(np.arange(len(own)), size)
    place = np.arange(len(data)) - start[word]
    symbol = np.where(place == size[word] - 1, BLANK, data).astype(np.int64)
    context = np.zeros(len(data), dtype=np.int64)
    for k in range(1, DEPTH + 1):
        before = np.where(place >= k, data[np.maximum(np.arange(len(data)) - k, 0)], BLANK).astype(np.int64)
        context |= before << (8 * (k - 1))
    told = place > 1
    return (context << 8 | symbol)[told], word[told]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after a shift of 8."""
    shift = np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a run of bits."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Tree:
    """Weighted nodes of all contexts from DEPTH down to 2 bytes, for one bit position of the bytes.

    A node is a context with the bits of the byte before this position. ``zeros``, ``ones``: its training counts;
    ``weighted``: ln of half its own estimate plus half the product of its children's. Levels go from the longest context.
    """

    def __init__(self, pairs: np.ndarray, n: np.ndarray, position: int):
        symbol = pairs & 255
        prefix = 1 << position | symbol >> (8 - position)
        self.bit = symbol >> (7 - position) & 1
        node, inverse = np.unique((pairs >> 8) << 8 | prefix, return_inverse=True)
        zeros, ones = (np.bincount(inverse, weights=n * (self.bit == b), minlength=len(node)) for b in (0, 1))
        own = weighted = log_estimate(zeros, ones)
        self.levels = [(node, inverse, zeros, ones, own, weighted)]
        for depth in range(DEPTH - 1, 1, -1):
            short = (node >> 8 & (1 << 8 * depth) - 1) << 8 | node & 255
            node, up = np.unique(short, return_inverse=True)
            zeros, ones, below = (np.bincount(up, weights=x, minlength=len(node)) for x in (zeros, ones, weighted))
            own = log_estimate(zeros, ones)
            weighted = np.logaddexp(own, below) - math.log(2)
            inverse = up[inverse]
            self.levels.append((node, inverse, zeros, ones, own, weighted))

    def log_probability(self, top: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 probability of each pair's bit: estimates of all depths, mixed by their nodes' weights. ``top``: (depth 1, depth 0) tables."""
        mixed = None
        for _, inverse, zeros, ones, own, weighted in self.levels:
            hit = np.where(self.bit == 1, ones[inverse], zeros[inverse])
            estimate = (hit + 0.5) / (zeros + ones + 1.0)[inverse]
            if mixed is None:
                mixed = estimate
            else:
                w = 0.5 * np.exp(np.minimum(0.6931472, own - weighted))[inverse]
                mixed = w * estimate + (1 - w) * mixed
        node = self.levels[-1][0][self.levels[-1][1]]
        for (weight, zeros, ones), at in zip(top, ((node >> 8 & 255, node & 255), (0, node & 255)), strict=True):
            a, b = zeros[at], ones[at]
            mixed = weight[at] * (np.where(self.bit == 1, b, a) + 0.5) / (a + b + 1.0) + (1 - weight[at]) * mixed
        return np.log10(mixed)


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for b in batches:
        pairs.append(b.column("pair").to_numpy())
        n.append(b.column("n").to_numpy())
    return np.concatenate(pairs), np.concatenate(n)


def pair_counts(words: DataFrame) -> DataFrame:
    """Training counts of each (context, byte) pair of the words, a stored table; pairs of held-out words alone have 0. Tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, word = contexts(batch.column("word").to_pylist())
            n = batch.column("c").to_numpy()[word]
            pair, inverse = np.unique(pair, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(inverse, weights=n, minlength=len(pair)).astype(np.int64))], names=["pair", "n"])

    return durable(words.select("word", "c").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))


def top_tables(pairs: DataFrame) -> tuple[tuple[np.ndarray, ...], ...]:
    """Weights and counts of the nodes of contexts of one byte and of none: at most 256 x 256 rows, whatever the corpus.

    Nodes of two bytes are summed for each of them by tasks that hold whole subtrees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = _whole(batches)
        for position in range(8):
            node, _, zeros, ones, _, weighted = Tree(pair, n, position).levels[-1]
            yield pa.RecordBatch.from_arrays([pa.array(node >> 8 & 255), pa.array(node & 255), *map(pa.array, (zeros, ones, weighted))], names=["context", "prefix", "zeros", "ones", "below"])

    nodes = subtrees(pairs).mapInArrow(run, "context long, prefix long, zeros double, ones double, below double")
    shape = (256, 256)
    zeros, ones, below = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for r in nodes.groupBy("context", "prefix").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).collect():
        zeros[r.context, r.prefix], ones[r.context, r.prefix], below[r.context, r.prefix] = r.zeros, r.ones, r.below
    tables = []
    for _ in range(2):
        own = log_estimate(zeros, ones)
        weighted = np.logaddexp(own, below) - math.log(2)
        tables.append((0.5 * np.exp(own - weighted), zeros, ones))
        zeros, ones, below = (x.sum(axis=0, keepdims=True) for x in (zeros, ones, weighted))
    return tuple(tables)


def subtrees(pairs: DataFrame) -> DataFrame:
    """Pairs whose contexts end in the same two bytes lie in one partition."""
    return pairs.repartition(F.shiftright("pair", 8).bitwiseAND(F.lit(0xFFFF)))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """log10 probability of each pair's byte in its context, by the weighted tree: (pair, score)."""
    top = top_tables(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = _whole(batches)
        score = np.zeros(len(pair))
        for position in range(8):
            score += Tree(pair, n, position).log_probability(top)
        for a in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[a : a + 100_000]), pa.array(score[a : a + 100_000])], names=["pair", "score"])

    return subtrees(pairs).mapInArrow(run, "pair long, score double")


def word_scores(words: DataFrame, scores: DataFrame) -> DataFrame:
    """log10 probability of each unit's word with its ending blank, a stored table: (word, c, score).

    Words are cut into blocks by their hash; a block asks once for each pair that its words hold, so what is joined is the
    distinct pairs of a block and no block holds more than about WORD_BLOCK words.
    """
    blocks = words.count() // WORD_BLOCK + 1
    w = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)))

    def asked(t: pa.Table) -> pa.Table:
        pair = np.unique(contexts(t.column("word").to_pylist())[0])
        return pa.table({"block": np.full(len(pair), t.column("block")[0].as_py()), "pair": pair})

    def told(t: pa.Table, s: pa.Table) -> pa.Table:
        pair, word = contexts(t.column("word").to_pylist())
        key, score = s.column("pair").to_numpy(), s.column("score").to_numpy()
        order = np.argsort(key)
        each = score[order][np.searchsorted(key[order], pair)]
        return pa.table({"word": t.column("word"), "c": t.column("c"), "score": np.bincount(word, weights=each, minlength=len(t))})

    need = w.groupBy("block").applyInArrow(asked, "block long, pair long").join(scores, "pair")
    return durable(w.groupBy("block").cogroup(need.groupBy("block")).applyInArrow(told, "word binary, c long, score double"))


def scored(docs: DataFrame) -> DataFrame:
    """Scores of each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows whose crc32 of the id modulo 7 is not 2. ``base_score`` is the add-one word model; ``score`` is the
    log10 probability of the words, each followed by a blank, and of the end (an empty word) under a weighted context tree
    of their bytes, before which stands a sign of how the document began; ``bits_per_byte`` is its code length. A missing text is an empty one: its only token is the end. Without
    training rows all estimates are one half.
    """
    rows = counted(docs, opening_words(docs))
    entries = rows.filter("word IS NOT NULL").select("chunk", "number", "word", "n")
    words = durable(entries.groupBy("word").agg(F.sum("n").alias("c")))
    token = F.expr("substring(word, 2)")
    plain = durable(words.groupBy(token.alias("token")).agg(F.sum("c").alias("c")))
    total = plain.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    known = word_scores(words, pair_scores(pair_counts(words)))
    known = known.select("word", "score", token.alias("token")).join(plain, "token").select("word", "score", "c", F.octet_length("token").alias("bytes"))
    dictionary = entries.select("chunk", "number", "word").join(known, "word").select("chunk", "number", "c", "score", "bytes")
    bags = rows.filter("word IS NULL").select(F.col("chunk").alias("home"), "doc_id", "held_out", "n_tokens", "ids", "times")
    n_train, least = int(total.n), math.log10(total.n + total.v + 1)

    def told(d: pa.Table, w: pa.Table) -> pa.Table:
        number = w.column("number").to_numpy()
        c, score, size = np.empty(len(number)), np.empty(len(number)), np.empty(len(number))
        c[number], score[number], size[number] = w.column("c").to_numpy(), w.column("score").to_numpy(), w.column("bytes").to_numpy() + 1
        base = np.log10(c + 1) - least
        out = []
        for ids, times in zip(d.column("ids").to_pylist(), d.column("times").to_pylist(), strict=True):
            i, n = np.cumsum(np.frombuffer(zlib.decompress(ids), dtype=np.uint32)), np.frombuffer(zlib.decompress(times), dtype=np.uint32).astype(np.float64)
            s = float(n @ score[i])
            out.append((int(n @ (c[i] > 0)), float(n @ base[i]), s, -s * math.log2(10) / float(n @ size[i])))
        known, base_score, own, bits = zip(*out, strict=True)
        m = len(d)
        return pa.table({"doc_id": d.column("doc_id"), "held_out": d.column("held_out"), "n_tokens": d.column("n_tokens"), "n_known": pa.array(known, type=pa.int64()), "train_tokens": pa.array(np.full(m, n_train, dtype=np.int64)), "base_score": pa.array(base_score, type=pa.float64()), "score": pa.array(own, type=pa.float64()), "bits_per_byte": pa.array(bits, type=pa.float64())})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return bags.groupBy("home").cogroup(dictionary.groupBy("chunk")).applyInArrow(told, schema)
