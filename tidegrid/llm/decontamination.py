"""Benchmark passages in documents within an edit distance: exact pieces first, then bit-parallel verification."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import as_row
from tidegrid.session import durable

#: Edits allowed as a share of an item's characters.
RATE = 0.08
#: Items go to the tasks in blocks of about so many bytes; each block is one pass over the documents.
BLOCK_BYTES = 16 << 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def cut(item: str, rate: float) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces of nearly equal length, with their offsets: any match within the budget leaves one piece whole."""
    n = int(len(item) * rate) + 1
    at = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def pattern_masks(pattern: str) -> dict[str, int]:
    """For each character, the set of its positions in the pattern as bits."""
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def nearest(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and where the first such substring ends.

    Myers' method: a column of the distance matrix is held as two bit sets, the rows where it grows and where it falls.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    grows, falls, now = full, 0, size
    best, end = size, 0
    for k, c in enumerate(text, 1):
        same = masks.get(c, 0)
        diagonal = (((same & grows) + grows) ^ grows) | same | falls
        up = falls | (full & ~(diagonal | grows))
        down = grows & diagonal
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        if now < best:
            best, end = now, k
        up, down = up << 1 & full, down << 1 & full
        grows = down | (full & ~(diagonal | up))
        falls = up & diagonal
    return best, end


def spans(hits: list[int], size: int, budget: int) -> Iterator[tuple[int, int]]:
    """Text ranges to verify, from the item's supposed starts; ranges that overlap are one."""
    low = high = None
    for s in sorted(hits):
        a, b = s - budget, s + size + budget
        if high is not None and a <= high:
            high = b
            continue
        if high is not None:
            yield max(0, low), high
        low, high = a, b
    if high is not None:
        yield max(0, low), high


class Matcher:
    """Items of one block, with an automaton over all their pieces."""

    def __init__(self, items: list[tuple[str, str]], rate: float):
        import ahocorasick

        self.items = [(i, x, int(len(x) * rate)) for i, x in items]
        self.masks: dict[int, dict[str, int]] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, x, _) in enumerate(self.items):
            for offset, piece in cut(x, rate):
                where.setdefault(piece, []).append((k, offset + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, at)
        self.automaton.make_automaton()

    def found(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(item, least distance, end in the normalised text) of each item within its budget."""
        starts: dict[int, list[int]] = {}
        for end, at in self.automaton.iter(text):
            for k, last in at:
                starts.setdefault(k, []).append(end - last)
        for k, hits in starts.items():
            i, x, budget = self.items[k]
            if k not in self.masks:
                self.masks[k] = pattern_masks(x)
            best = min((nearest(self.masks[k], len(x), text[a:b]) + (a,) for a, b in spans(hits, len(x), budget)), default=None)
            if best and best[0] <= budget:
                yield i, best[0], best[1] + best[2]


def digest(text: str = "text") -> Column:
    return F.md5(F.col(text).cast("binary"))


def matches(docs: DataFrame, items: DataFrame, rate: float, block_bytes: int) -> DataFrame:
    """doc_id, item (digest of its text), edits, end for each document row and each item text it holds. ``doc_id`` may be of any type.

    Equal item texts are one. Their blocks are balanced, for different texts are dealt by hash; the driver holds one block at a time,
    and of several blocks each one's matches are stored before the next is read.
    """
    texts = items.select(digest().alias("item"), "text").dropDuplicates(["item"])
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    texts = durable(texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))) if n > 1 else texts.withColumn("block", F.lit(0))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(block: int) -> DataFrame:
        own = [(r.item, x) for r in texts.filter(F.col("block") == block).collect() if (x := normal(r.text))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(own, rate) if own else None
            for batch in batches:
                types = (batch.schema.field("doc_id").type, pa.string(), pa.int64(), pa.int64())
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if text and matcher:
                        out += [(doc, *x) for x in matcher.found(normal(text))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=t) for k, t in enumerate(types)], names=["doc_id", "item", "edits", "end"])

        found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item string, edits long, end long")
        return durable(found) if n > 1 else found

    found = one(0)
    for block in range(1, n):
        found = found.unionByName(one(block))
    return found


def filled(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter(F.length(F.trim("text")) > 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of document and benchmark item: doc_id, item_id, edits (least distance), end (in the normalised text).

    Both texts are put in lower case with single blanks. An item matches if some substring of the document is within
    ``rate`` of its length in edits; short items thus must occur exactly, empty or missing ones match nothing. Repeated
    document rows give a pair each, items of equal text one each. The benchmark may be of any size: it goes to the tasks
    in blocks of bounded bytes, one pass over the documents a block.
    """
    items = filled(benchmark)
    found = matches(docs, items, rate, block_bytes)
    return found.join(items.select(digest().alias("item"), "item_id"), "item").select("doc_id", "item_id", "edits", "end")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark item; all columns are kept, rows are judged one by one by their text."""
    # texts are found by a digest, for document ids may be missing or repeated
    own = digest()
    bad = matches(docs.select(own.alias("doc_id"), "text"), filled(benchmark), rate, block_bytes).select(F.col("doc_id").alias("digest")).distinct()
    return docs.select(as_row(docs), own.alias("digest")).join(bad, "digest", "left_anti").select("row.*")
