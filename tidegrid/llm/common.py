"""Helpers that several operators share: tables, defaults for missing columns, words as numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def text_of(c: str = "text") -> Column:
    """A missing text is an empty one."""
    return F.coalesce(F.col(c), F.lit(""))


def as_row(docs: DataFrame) -> Column:
    """All columns of a table as one value, so that columns added beside it never clash with them."""
    return F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")


def with_text(docs: DataFrame, text: Column, changed: Column) -> Column:
    """The row with another text where ``changed`` holds; ``n_chars``, if there is one, follows the text."""
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return F.when(changed, row).otherwise(F.col("row")).alias("row")


def words_of(text: Column) -> Column:
    """Words between runs of blank, tab, line feed, vertical tab, form feed and carriage return."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def remainder(c: Column, n: int) -> Column:
    """crc32 of a value's text, modulo n; a missing value counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def odd_constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = 0xB5AD4ECEDA1CE2A9
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): differences of one prefix sum of a polynomial, then finalised."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_CODES[data] * _powers(_STEP, n), out=total[1:])
        back = _powers(_BACK, n)
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of UTF-8 bytes."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_BLANK[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(texts: list[bytes], most: int = 1 << 21):
    """Runs of (first, last + 1) texts of at most ``most`` bytes together; a longer text is a run of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array with a line feed after each, and where each begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8), np.cumsum(sizes) - sizes
