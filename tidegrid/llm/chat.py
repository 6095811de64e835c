"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
OPEN, CLOSE, HEAD, TAIL = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"(<|\[)(/?(?:s>|INST\]))"


def escaped(text: Column) -> Column:
    """No control string is left in the result, and ``unescaped`` gives the text back: each backslash is doubled, then one put after the bracket of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns(conversations: DataFrame) -> DataFrame:
    """Turns of each conversation in order. Missing roles and texts are empty; equal turn numbers go by role and text; missing ones come first.

    A conversation is one value in any chat format, so its rows meet in one place; it is bounded by what a row can hold.
    """
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def examples(conversations: DataFrame) -> DataFrame:
    """Every assistant turn as an example: all turns before it as context, only its reply under the loss mask.

    Columns: conv_id, example (0, 1, ...), formatted, loss_start and loss_length (code points from 0).
    What follows the last assistant turn, or a conversation without one, becomes a last example of loss length 0, so that
    no turn is lost. The reply's end mark is not under the mask. Conversation ids may be missing; such rows are one conversation.
    """
    piece = lambda t: F.concat(F.lit(OPEN + HEAD), escaped(t["role"]), F.lit(TAIL), escaped(t["text"]), F.lit(CLOSE))
    d = turns(conversations).select(
        "conv_id",
        F.transform("turns", piece).alias("parts"),
        F.transform("turns", lambda t: F.length(escaped(t["text"]))).alias("sizes"),
        F.filter(F.transform("turns", lambda t, k: F.when((t["role"] == "assistant") | (k == F.size("turns") - 1), k)), lambda k: k.isNotNull()).alias("ends"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("own"),
    )
    d = d.select("conv_id", "parts", "sizes", "own", F.posexplode("ends").alias("example", "at"))
    d = d.select("conv_id", "example", F.array_join(F.slice("parts", 1, F.col("at") + 1), "").alias("formatted"), F.expr("sizes[at]").alias("size"), F.expr("own[at]").alias("trained"))
    return d.select(
        "conv_id", "example", "formatted",
        F.when(F.col("trained"), F.length("formatted") - F.col("size") - len(CLOSE)).otherwise(F.length("formatted")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.col("size")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Roles and texts read back from a formatted example."""

    def turn(p: Column) -> Column:
        tail = F.instr(p, TAIL)
        head = len(OPEN + HEAD)
        return F.struct(
            unescaped(p.substr(F.lit(head + 1), tail - 1 - head)).alias("role"),
            unescaped(p.substr(tail + len(TAIL), F.length(p))).alias("text"),
        )

    return F.transform(F.filter(F.split(formatted, CLOSE), lambda p: p != ""), turn)


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, as it was before formatting."""
    return unescaped(formatted.substr((start + 1).cast("int"), length.cast("int")))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: turns of the last one, replies of all of them in order."""
    last = F.max_by("formatted", "example")
    d = formatted.select("conv_id", "example", "formatted", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    d = d.groupBy("conv_id").agg(
        last.alias("last"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    d = d.select("conv_id", read_turns(F.col("last")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
