"""Concatenate and cut: token ids of all documents in one sequence, cut into windows of a fixed length."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.session import durable

END = 1
WINDOW = 2048
#: Special token of the vocabulary; texts that hold its string take the slower path.
SPECIAL = "<|endoftext|>"
#: Offsets are broadcast up to so many input partitions (16 bytes each), and joined otherwise.
MOST_PARTS = 4_000_000


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str):
    """Ids of a text by the vocabulary of ``json_path``.

    The same merges as ranks in another library give the same ids four times as fast. A text with the special token's
    string goes to the first library, which reads it as that token, and so does one whose white space runs on for longer
    (about a million characters) than the other library's pattern can go back.
    """
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {}
    with open(ranks_path, "rb") as f:
        for line in f:
            token, _, rank = line.partition(b" ")
            ranks[base64.b64decode(token)] = int(rank)
    fast, whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(json_path)

    def ids(text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return fast.encode_to_numpy(text)
            except ValueError:
                pass
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return ids


def tokenised(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """First pass, a stored table: doc_id, part, before (tokens of the partition before this document), n, ids.

    ``part`` and ``before`` belong to the stored rows, so later passes see one order even when tasks run again. Ids are
    two bytes each, as the vocabulary has fewer than 65,536. A missing text is an empty one: its only token is the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, before, part = encoder(json_path, ranks_path, pattern), 0, TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                own = [np.append(ids(t or ""), END).astype(np.uint16) for t in rows.column("text").to_pylist()]
                n = np.array([len(x) for x in own], dtype=np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(start), pa.array(n), pa.array([x.tobytes() for x in own], type=pa.binary())],
                    names=["doc_id", "part", "before", "n", "ids"],
                )

    return durable(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part long, before long, n long, ids binary"))


def offsets(tokens: DataFrame) -> DataFrame:
    """Tokens before each partition: a prefix sum over one total per partition."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def packed(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second pass: the pieces of each document, one for each window that it reaches.

    Columns: doc_id, start (tokens of the document before the piece), length, ids_crc32 (of the ids as little-endian 32-bit
    numbers), doc_tokens, sequence_id, offset (in the sequence), boundary (whether the document goes on in another
    window), ids (little-endian 16-bit). All sequences are full but the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, first, raw in zip(batch.column("doc_id").to_pylist(), batch.column("first").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, dtype="<u2")
                at, n = 0, len(ids)
                while at < n:
                    sequence, offset = divmod(first + at, window)
                    length = min(window - offset, n - at)
                    piece = ids[at : at + length]
                    out.append((doc, at, length, zlib.crc32(piece.astype("<u4").tobytes()), n, sequence, offset, length < n, piece.tobytes()))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)] if out else [pa.array([], type=t) for t in SCHEMA.types], schema=SCHEMA)

    base = durable(offsets(tokens))
    base = F.broadcast(base) if base.count() <= MOST_PARTS else base
    rows = tokens.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "ids")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("boundary", pa.bool_()), ("ids", pa.binary())])


def public_tokenizer() -> tuple[str, str, str]:
    """Paths and pattern of the installed byte-level vocabulary of 50 thousand."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (see ``packed``) of all rows of (doc_id, text) by the installed vocabulary.

    A missing text is an empty one, which is its end token alone; a missing doc_id is kept as such. Repeated rows are packed as
    often as they occur. Texts are of any length and cut freely; other columns are not read. An empty table has no pieces.
    """
    return packed(tokenised(docs, *public_tokenizer()), window)
