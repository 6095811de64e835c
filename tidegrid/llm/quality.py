"""Quality rules: fixed rules on one text, and line frequency across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import as_row, text_of, with_text, words_of
from tidegrid.session import durable

#: A line above this share of a host's distinct texts, and above so many of them, is removed there.
SHARE, FLOOR = 0.01, 5
#: A document that loses more than this share of the characters of its lines is depleted.
DEPLETED = 0.3
MIN_WORDS = 50


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def window(words: Column | str, i: Column) -> Column:
    """Hash of the 3-word window at position i."""
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def with_repeats(d: DataFrame, words: str, out: str) -> DataFrame:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted as longs, the upper bits of the hash above the position; neighbours of equal upper bits are
    candidates, and those alone are compared by their whole hash. Each step is a column of its own: an expression inside
    a lambda would be evaluated again for every element.
    """
    d = d.withColumn("_bits", F.length(F.bin(F.size(words))))
    d = d.withColumn(
        "_packed",
        F.expr(
            f"CASE WHEN size({words}) < 3 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size({words}) - 3), "
            f"i -> shiftleft(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)), _bits) | i)) END"
        ),
    )
    d = d.withColumn(
        "_near",
        F.expr(
            "filter(_packed, (p, k) -> shiftrightunsigned(p ^ coalesce(get(_packed, k + 1), ~p), _bits) = 0"
            " OR shiftrightunsigned(p ^ coalesce(get(_packed, k - 1), ~p), _bits) = 0)"
        ),
    )
    d = d.withColumn("_sorted", F.expr("array_sort(transform(_near, p -> p & (shiftleft(1L, _bits) - 1)))"))
    d = d.withColumn("_sorted", F.array_sort(F.transform("_sorted", lambda i: F.struct(window(words, i.cast("int")).alias("h"), i.alias("i")))))
    same = F.expr("filter(_sorted, (x, k) -> get(_sorted, k + 1).h <=> x.h OR (k > 0 AND get(_sorted, k - 1).h <=> x.h)).i")
    d = d.withColumn("_at", F.array_sort(same))
    # a window adds the words that the next one does not begin with
    added = F.transform("_at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - i, F.lit(3))))
    d = d.withColumn(out, F.coalesce(F.aggregate(added, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"))
    return d.drop("_bits", "_packed", "_near", "_sorted", "_at")


def digest(source: str = "source") -> Column:
    """Equal hosts and texts have equal digests, and get equal verdicts."""
    return F.md5(F.concat(F.coalesce(F.col(source), F.lit("")), F.lit("\n"), text_of()).cast("binary"))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts of the base rules for each row, and its lines as hashes with their lengths.

    Columns: ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lines (array of hash and
    size). A missing or empty text has counts of 0 and fails for its number of words.
    """
    d = docs.select(*keep, text_of().alias("_text")).withColumn("_words", words_of(F.col("_text")))
    d = with_repeats(d, "_words", "n_repeat_words")
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), has_word))
    d = d.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("_lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.length(x).alias("size"))).alias("lines"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def frequent_lines(measured: DataFrame, share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """Lines above the limit of their host: host, line, texts, documents.

    The limit is ``share`` of the host's distinct texts, ``floor`` at least. Copies of one text are one document for it, or a
    group of copies would remove itself; ``documents`` counts them all. All aggregates combine before they shuffle, so a
    line of a third of all documents is one row a task.
    """
    per_text = measured.select("host", "digest", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("host", "digest", "line").agg(F.count(F.lit(1)).alias("n"))
    lines = per_text.groupBy("host", "line").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("documents")).filter(F.col("texts") > floor)
    hosts = durable(measured.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size")))
    return lines.join(hosts, "host").filter(F.col("texts") > F.lit(float(share)) * F.col("size")).drop("size")


def judged(docs: DataFrame, share: float = SHARE, floor: int = FLOOR, depleted: float = DEPLETED) -> DataFrame:
    """Base counts and verdict of each row, a stored table: doc_id, digest, the counts, removed (line hashes), kept.

    A line above its host's limit is removed from every document of the host. A document is rejected if it fails a base rule
    or more than ``depleted`` of its characters are in removed lines. A missing host is a host of its own.
    """
    host = F.coalesce(F.col("source"), F.lit(""))
    m = durable(measures(docs.withColumns({"_host": host, "_digest": digest(), "_uid": F.monotonically_increasing_id()}), "_uid", "doc_id", "_host", "_digest")
                .withColumnsRenamed({"_uid": "uid", "_host": "host", "_digest": "digest"}))
    often = durable(frequent_lines(m, share, floor))
    hits = (
        m.select("uid", "host", F.explode("lines").alias("x")).select("uid", "host", "x.line", "x.size")
        .join(often, ["host", "line"])
        .groupBy("uid").agg(F.sum("size").alias("gone"), F.collect_set("line").alias("removed"))
    )
    d = m.join(hits, "uid", "left")
    whole = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    lost = F.coalesce(F.col("gone"), F.lit(0))
    return d.select(
        "doc_id", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
        (~F.col("base_failed") & (lost <= F.lit(depleted) * whole)).alias("kept"),
    )


def cleaned(docs: DataFrame, share: float = SHARE, floor: int = FLOOR, depleted: float = DEPLETED) -> DataFrame:
    """Documents that are kept, without their removed lines; ``n_chars`` follows the text, other columns are left as they are.

    Only documents that change are looked up by their digest; a missing text counts as an empty one and is rejected.
    """
    changed = judged(docs, share, floor, depleted).filter(~F.col("kept") | (F.size("removed") > 0)).groupBy("digest").agg(F.first("kept").alias("kept"), F.first("removed").alias("removed"))
    d = docs.select(as_row(docs), digest().alias("digest")).join(durable(changed), "digest", "left")
    d = d.filter(F.coalesce(F.col("kept"), F.lit(True)))
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(normalised(x)))), "\n")
    return d.select(with_text(docs, left, F.size("removed") > 0)).select("row.*")
