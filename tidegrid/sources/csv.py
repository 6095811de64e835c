"""Delimited sensor exports: dialect detection and parsing, all inside Spark.

Files are read once as lines.  The dialect of each file comes from its first
lines and is joined back by file, so nothing about the files passes through the
driver.

A quote opens a field only at the field's start.  What a line does to the state
of a reader (at a record's start, or inside quotes) is a function of two states;
these functions are composed over all lines of a file by a prefix scan, so that
splits of one file are read apart and no task sees a whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.plans.blocks import POSITION, rolling, running
from tidegrid.plans.series import BLOCK, Series
from tidegrid.session import durable

# Separators by priority, the default, and the rule for the semicolon.
SEPARATORS = (",", "\t", "|")
DEFAULT_SEPARATOR = ","
HEAD_LINES = 5
BOM = "\ufeff"

#: Lines that a record may span; a quote that is still open after them is an ordinary character.
RECORD_LINES = 1000


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, pos, value``: lines in file order (``pos`` orders lines inside a file).

    A file whose lines are all valid UTF-8 is read so, any other one as Latin-1. Lines are stored, for they are read again.
    """
    df = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id")).alias("pos"),
        "value",
        # the reader hands the bytes on as they are
        F.is_valid_utf8("value").alias("valid"),
    )
    df = durable(df)
    good = durable(df.groupBy("file").agg(F.bool_and("valid").alias("utf8")))
    return df.join(good, "file").select("file", "pos", F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("value"))


def _exact(sep: Column) -> Column:
    return F.concat(F.lit("\\Q"), sep, F.lit("\\E"))


def _closes(content: Column) -> Column:
    """Whether quoted text ends: a quote is left once doubled ones are gone."""
    return F.contains(F.replace(content, F.lit('""'), F.lit("")), F.lit('"'))


def quote_states(value: Column, sep: Column) -> Column:
    """What a line does to a reader: struct of ``fresh`` and ``inside``, each telling whether the line ends inside quotes if it began so.

    Pieces between separators are folded with both states at once. Where a field begins, a quote opens; inside quotes a
    separator is text, and a quote that is not doubled ends them (what follows it, to the separator, is text again).
    """
    opens = lambda x: x.startswith('"') & ~_closes(F.substr(x, F.lit(2)))
    step = lambda state, x: F.when(state, ~_closes(x)).otherwise(opens(x))
    both = F.aggregate(
        F.split(value, _exact(sep)), F.struct(F.lit(False).alias("fresh"), F.lit(True).alias("inside")),
        lambda s, x: F.struct(step(s["fresh"], x).alias("fresh"), step(s["inside"], x).alias("inside")),
    )
    same = F.struct(F.lit(False).alias("fresh"), F.lit(True).alias("inside"))
    return F.when(F.contains(value, F.lit('"')), both).otherwise(same)


def whole_records(lines: DataFrame, dialects: DataFrame, most: int = RECORD_LINES) -> DataFrame:
    """``file, pos, value, unclosed``: lines joined where a quoted field holds line ends, at its first line's position.

    A record spans ``most`` lines at most. A quote that opens a field and is not closed within them is an ordinary character:
    its line is a record of its own, with ``unclosed`` set, and the next line is read afresh.
    """
    s = Series(("file",), "pos")
    at = F.when(F.col("pos") == F.col("__first"), F.replace("value", F.lit(BOM), F.lit(""))).otherwise(F.col("value"))
    first = durable(lines.groupBy("file").agg(F.min("pos").alias("__first"), F.bool_or(F.contains("value", F.lit('"'))).alias("__quoted")).join(dialects.select("file", "sep"), "file"))
    d = lines.join(first, "file")
    plain = d.filter(~F.col("__quoted")).select("file", "pos", "value", F.lit(False).alias("unclosed"))
    d = d.filter("__quoted").withColumn("__f", quote_states(at, F.col("sep"))).select("file", "pos", "value", F.col("__f.fresh").alias("__open"), F.col("__f.inside").alias("__stay"))
    d = d.withColumn(BLOCK, F.col("pos.at"))
    d = running(d, s, {"__n": ("count", F.lit(1))}, keep_block=True)
    # the number of the next line that closes, from this line on and then from the next one on
    d = running(d, s, {}, {"__upto": ("min", F.when(~F.col("__stay"), F.col("__n")))})
    d = durable(d.withColumn(POSITION, F.col("__n") - 1))
    d = rolling(d, s, 0, 1, lambda w: {"__upto": F.lead("__upto").over(w)}, keep_block=True)
    within = F.coalesce(F.col("__upto") - F.col("__n") < most, F.lit(False))
    # stored, as each running fold below reads its input twice
    d = durable(d.withColumns({"unclosed": F.col("__open") & ~within, "__open": F.col("__open") & within}))
    # functions of two states: constant, identity or exchange. The state is the last constant, exchanged as often as asked since
    d = running(d, s, {"__turns": ("sum", (F.col("__open") & ~F.col("__stay")).cast("long"))}, keep_block=True)
    fixed = F.when(F.col("__open") == F.col("__stay"), F.struct("__n", F.col("__open").alias("to"), F.col("__turns").alias("turns")))
    d = running(d, s, {"__fixed": ("max", fixed)})
    turned = (F.col("__turns") - F.coalesce(F.col("__fixed.turns"), F.lit(0))) % 2 == 1
    d = durable(d.withColumn("__inside", F.coalesce(F.col("__fixed.to"), F.lit(False)) != turned))
    d = rolling(d, s, 1, 0, lambda w: {"__begins": ~F.coalesce(F.lag("__inside").over(w), F.lit(False))}, keep_block=True)
    d = running(d, s, {"__record": ("sum", F.col("__begins").cast("long"))})
    parts = F.array_sort(F.collect_list(F.struct("pos", "value", "unclosed", "__begins")))
    d = d.groupBy("file", "__record").agg(parts.alias("p"))
    # only a line read afresh can have left its quote open
    odd = F.exists("p", lambda x: x["unclosed"] & x["__begins"])
    return plain.unionByName(d.select("file", F.col("p")[0]["pos"].alias("pos"), F.array_join(F.col("p.value"), "\n").alias("value"), odd.alias("unclosed")))


def _count(c: Column, sep: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit("")))


def sniff(lines: DataFrame) -> DataFrame:
    """``file, sep, skip, header, header_pos``: one row per file from its first lines."""
    w = Window.partitionBy("file").orderBy("pos")
    head = lines.withColumn("value", F.ltrim(F.replace("value", F.lit(BOM), F.lit(""))))
    # the rank filter is pushed below the shuffle, so each task sends a few lines per file
    head = head.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= HEAD_LINES + 1)
    hint = F.max(F.when((F.col("rn") == 1) & F.lower("value").startswith("sep="), F.substring("value", 5, 1)))
    first = F.col("rn") <= HEAD_LINES
    g = head.groupBy("file").agg(
        hint.alias("hint"),
        F.min(F.when(first, _count(F.col("value"), ";"))).alias("semi"),
        *[F.min(F.when(first, _count(F.col("value"), s))).alias(f"n{i}") for i, s in enumerate(SEPARATORS)],
        *[F.max(F.when(F.col("rn") == k, F.struct("value", "pos"))).alias(f"l{k}") for k in (1, 2)],
    )
    best = F.greatest(*[F.col(f"n{i}") for i in range(len(SEPARATORS))])
    pick = F.when(F.col("semi") > 2, ";")
    for i, sep in enumerate(SEPARATORS):
        pick = pick.when((F.col(f"n{i}") == best) & (best > 0), sep)
    hinted = F.col("hint").isNotNull()
    return g.select(
        "file",
        F.coalesce("hint", pick.otherwise(DEFAULT_SEPARATOR)).alias("sep"),
        hinted.cast("int").alias("skip"),
        F.when(hinted, F.col("l2.value")).otherwise(F.col("l1.value")).alias("header"),
        F.when(hinted, F.col("l2.pos")).otherwise(F.col("l1.pos")).alias("header_pos"),
    )


def _fields(value: Column, sep: Column) -> Column:
    """Trimmed fields of a record. A field that begins with a quote and is closed is the text between the quotes, doubled ones single, and what follows."""
    exact = _exact(sep)
    quoted = '"(?:[^"]|"")*+"'
    pattern = F.concat(exact, F.lit(f"(?:{quoted}[^"), exact, F.lit("]*+|[^"), exact, F.lit("]*+)"))

    def text(field: Column) -> Column:
        head = F.regexp_extract(field, f"^{quoted}", 0)
        inner = F.replace(F.substr(head, F.lit(2), F.length(head) - 2), F.lit('""'), F.lit('"'))
        return F.when(head == "", field).otherwise(F.concat(inner, F.substr(field, F.length(head) + 1)))

    found = F.transform(F.regexp_extract_all(F.concat(sep, value), pattern, F.lit(0)), lambda m: F.trim(text(F.substr(m, F.length(sep) + 1))))
    plain = F.transform(F.split(value, exact), lambda x: F.trim(x))
    return F.when(F.contains(value, F.lit('"')), found).otherwise(plain)


def parse(lines: DataFrame, dialects: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fields as trimmed STRING columns found by header name, NULL where a file has no such column.

    The hint and header lines go by their position, empty lines by their content. Column names are compared after trimming.
    """
    # a name may have blanks before its quotes
    bare = lambda x: F.when((F.length(x) > 1) & x.startswith('"') & x.endswith('"'), F.trim(F.substr(x, F.lit(2), F.length(x) - 2))).otherwise(x)
    d = dialects.withColumn("__names", F.transform(_fields(F.col("header"), F.col("sep")), bare))
    d = d.withColumns({f"__p{i}": F.array_position("__names", F.lit(c)).cast("int") for i, c in enumerate(columns)})
    # one row a file, stored: its exact size decides whether it is broadcast
    d = durable(d.select("file", "sep", "header_pos", *[f"__p{i}" for i in range(len(columns))]))
    d = lines.join(d, "file").filter((F.col("pos") > F.col("header_pos")) & (F.trim("value") != ""))
    d = d.withColumn("__f", _fields(F.col("value"), F.col("sep")))
    field = lambda i: F.when(F.col(f"__p{i}") > 0, F.get("__f", F.col(f"__p{i}") - 1))
    return d.select("file", "pos", *[F.nullif(field(i), F.lit("")).alias(c) for i, c in enumerate(columns)])


def read_records(spark: SparkSession, paths: str | Sequence[str], most: int = RECORD_LINES) -> tuple[DataFrame, DataFrame]:
    """Records of exports of mixed dialects and encodings (see ``whole_records``), and the dialect of each file. A header may span lines too."""
    lines = durable(read_lines(spark, paths))
    dialects = durable(sniff(lines))
    records = durable(whole_records(lines, dialects, most))
    heads = records.join(dialects.select("file", F.col("header_pos").alias("pos")), ["file", "pos"]).select("file", F.replace("value", F.lit(BOM), F.lit("")).alias("whole"))
    whole = dialects.join(heads, "file", "left").withColumn("header", F.coalesce("whole", "header"))
    return records, whole.drop("whole")


def read_export(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], most: int = RECORD_LINES) -> DataFrame:
    """Read exports of mixed dialects and encodings into the STRING columns named by ``columns``."""
    records, dialects = read_records(spark, paths, most)
    return parse(records, dialects, columns)


def unclosed_quotes(records: DataFrame) -> DataFrame:
    """``file, pos, value`` of the records that hold a quote which was opened and not closed in time."""
    return records.filter("unclosed").select("file", "pos", "value")


def read_weather(df: DataFrame, time: str, zone: str, values: Sequence[str]) -> DataFrame:
    """Text times with explicit offsets to the local wall clock, values to DOUBLE."""
    from tidegrid.functions.columns import clean_number, to_local

    instant = F.try_to_timestamp(F.col(time))
    return df.select(to_local(instant, zone).alias("ts"), *[clean_number(c).alias(c) for c in values]).filter(
        F.col("ts").isNotNull()
    )
