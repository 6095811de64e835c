"""WARC derivatives: each response becomes a metadata record and, for text, a plain-text conversion record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Elements whose content is not text, and elements that end a line (fixed values).
DROPPED = ("script", "style", "noscript", "template", "svg", "head")
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title"
#: Character references that are read (fixed values); the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#x27;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A record identifier made from the parts alone, so that a task that runs again makes the same one."""
    h = F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, date: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Response records of raw pages (url, html): record_id, target_uri, date, block. Missing values are empty texts; equal pages are equal records."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF)
    )
    return pages.select(*keep, record_id(F.lit("response"), url, html).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.concat(head, html).alias("block"))


def once(c: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(c), then), 1)


def without(name: str):
    """A step that drops the elements of a name. An opening tag that is never closed takes the rest of the text, which stays, so it costs one pass: no later one is closed either."""
    pattern = rf"(?s)<(?i:{name})\b(?:[^>]*>.*?</(?i:{name})\s*>|(?<=(<(?i:{name})))(.*))"
    return lambda t: F.regexp_replace(t, pattern, "$1$2")


def by_first(names: str) -> str:
    """The same alternatives, grouped by their first letter, so that most are not tried."""
    tails: dict[str, list[str]] = {}
    for name in names.split("|"):
        tails.setdefault(name[0], []).append(name[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in tails.items())


def replaced(t: Column, mark: str, pattern: str, by: str) -> Column:
    """Matches of a pattern that ends in ``mark`` replaced, in the part up to the last mark."""
    tail = lambda rest: F.concat(F.regexp_replace(F.substr(t, F.lit(1), F.length(t) - F.length(rest)), pattern, by), rest)
    return F.when(F.contains(t, F.lit(mark)), once(F.substring_index(t, mark, -1), tail)).otherwise(t)


def references(t: Column) -> Column:
    """Character references read: the text is cut before each ampersand, so no reference is made of what another one becomes."""
    part = lambda x: reduce(lambda c, e: c.when(F.startswith(x, F.lit(e[0][1:])), F.concat(F.lit(e[1]), F.substr(x, F.lit(len(e[0]))))), ENTITIES, F.when(F.lit(False), x))
    return F.concat_ws("", F.transform(F.split(t, "&"), lambda x, i: F.when(i == 0, x).otherwise(part(x).otherwise(F.concat(F.lit("&"), x)))))


def lines(t: Column) -> Column:
    """Lines without the blanks around them, empty ones dropped. Blanks and line ends before a last sign of Unicode that ends a line go too."""
    trimmed = F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    odd = reduce(lambda a, b: a | b, [F.endswith(t, F.lit(x)) for x in "\u0085\u2028\u2029"])
    return F.when(odd, F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")).otherwise(trimmed)


def plain_text(html: Column) -> Column:
    """Text of an HTML page: comments, scripts and the like dropped, block elements as line ends, references read, blanks collapsed.

    A step is taken only where its mark occurs, as far as that is cheap to tell. Time is in proportion to the page's length, also
    where tags or comments are opened many times and never closed.
    """
    either = lambda t, marks: reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks])
    seldom = DROPPED[2:-1]
    steps = [lambda t: F.when(F.contains(t, F.lit("<!--")), F.regexp_replace(t, r"(?s)<!--(?:.*?-->|(?<=(<!--))(.*))", "$1$2")).otherwise(t)]
    steps += [without(name) for name in DROPPED[:2]]
    steps.append(lambda t: F.when(F.rlike(t, F.lit(f"</(?i:{'|'.join(seldom)})")), reduce(once, map(without, seldom), t)).otherwise(t))
    steps += [without(name) for name in DROPPED[-1:]]
    steps.append(lambda t: replaced(t, ">", rf"</?(?i:{by_first(BLOCKS)})\b[^>]*>", "\n"))
    steps.append(lambda t: replaced(t, ">", r"<[!/?a-zA-Z][^>]*>", ""))
    steps.append(lambda t: F.when(F.contains(t, F.lit("&")), references(t)).otherwise(t))
    steps.append(lambda t: F.when(either(t, ("  ", "\t", "\r", "\f", "\x0b")), F.regexp_replace(t, r"[ \t\r\f\x0B](?:[ \t\r\f\x0B]+|(?<=[\t\r\f\x0B]))", " ")).otherwise(t))
    return reduce(once, [*steps, lines], html)


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b(?:[^>]*>(.*?)</title\s*>|.*)", 1), r"\s+", " "))


def derivatives(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of response records (record_id, target_uri, date, block).

    A block is an HTTP head, an empty line and a payload; without an empty line it is all head. Columns: ``keep``, type,
    record_id, refers_to, concurrent_to (the other derivative, or null), target_uri, date, content_type, content_length,
    block_digest, source_block_digest, source_payload_digest, content. The metadata content lists the status, all source
    headers as they were, the title and the digests; conversions are made of text/html and text/plain only. Missing blocks
    and addresses are empty texts. Rows are independent of each other: no shuffle, repeated rows give repeated records.
    """
    d = records.select(
        *keep, "record_id", F.coalesce("target_uri", F.lit("")).alias("uri"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("block", F.lit("")).alias("block")
    )
    at = F.instr("block", CRLF + CRLF)
    d = d.withColumn("head", F.when(at > 0, F.col("block").substr(F.lit(1), at - 1)).otherwise(F.col("block")))
    d = d.withColumn("payload", F.when(at > 0, F.col("block").substr(at + 4, F.length("block"))).otherwise(F.lit("")))
    d = d.withColumn("kind", F.lower(F.regexp_extract("head", r"(?i)\ncontent-type:[ \t]*([^;\s]*)", 1)))
    title = title_of(F.col("payload"))
    is_text = F.col("kind").isin("text/html", "text/plain")
    d = d.withColumns({"source_block_digest": digest(F.col("block")), "source_payload_digest": digest(F.col("payload"))})
    fields = F.concat(
        F.lit("status: "), F.regexp_extract("head", r"^HTTP/\S+ ([0-9]+)", 1), F.lit(CRLF),
        # header lines as in the source, marked as such
        F.regexp_replace(F.concat(F.regexp_replace("head", r"^[^\r\n]*(?:\r\n)?", ""), F.lit(CRLF)), r"([^\r\n]+)\r\n", "source-header: $1\r\n"),
        F.when(F.col("kind") == "text/html", F.concat(F.lit("title: "), title, F.lit(CRLF))).otherwise(F.lit("")),
        F.lit("source-payload-digest: "), F.col("source_payload_digest"), F.lit(CRLF),
    )
    fields = F.when(F.col("head") == "", F.concat(F.lit("source-payload-digest: "), F.col("source_payload_digest"), F.lit(CRLF))).otherwise(fields)
    text = F.when(F.col("kind") == "text/html", plain_text(F.col("payload"))).otherwise(F.col("payload"))
    own = lambda kind: record_id(F.lit(kind), F.col("record_id"))
    record = lambda kind, other, content_type, content: F.struct(
        F.lit(kind).alias("type"), own(kind).alias("id"), other.alias("concurrent_to"), F.lit(content_type).alias("content_type"), content.alias("content")
    )
    meta = record("metadata", F.when(is_text, own("conversion")), "application/warc-fields", fields)
    made = record("conversion", own("metadata"), "text/plain; charset=utf-8", text)
    d = d.withColumn("r", F.explode(F.when(is_text, F.array(meta, made)).otherwise(F.array(meta))))
    return d.select(
        *keep, "r.type", F.col("r.id").alias("record_id"), F.col("record_id").alias("refers_to"), "r.concurrent_to", F.col("uri").alias("target_uri"), "date", "r.content_type",
        F.octet_length("r.content").cast("long").alias("content_length"), digest(F.col("r.content")).alias("block_digest"), "source_block_digest", "source_payload_digest", "r.content",
    )


def rendered(records: DataFrame) -> DataFrame:
    """Derivative records as WARC 1.1 text, in one column ``value``, without the last line end."""
    line = lambda name, c: F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(CRLF)))
    c = F.col
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", c("type")), line("WARC-Record-ID", c("record_id")), line("WARC-Date", c("date")), line("WARC-Target-URI", c("target_uri")),
        line("WARC-Refers-To", c("refers_to")), line("WARC-Concurrent-To", c("concurrent_to")), line("WARC-Block-Digest", c("block_digest")),
        line("WARC-Source-Payload-Digest", c("source_payload_digest")), line("Content-Type", c("content_type")), line("Content-Length", c("content_length")),
    )
    return records.select(F.concat(head, F.lit(CRLF), c("content"), F.lit(CRLF)).alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files, one for each partition, compressed. The writer's line end closes a record."""
    rendered(records).write.option("lineSep", CRLF).option("compression", "gzip").text(path)
