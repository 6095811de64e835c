"""The registered queries of the subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import chat, decontamination, golay, minhash, packing, pii, quality, quality_model, sharding, strassen, text_tree, warc, whitening
from tidegrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return deco


#: crc32 over UTF-8 bytes for DuckDB (fixed values: the reflected polynomial and the initial and final masks).
CRC_SQL = """
_t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(0, 256) r(i)))"""


def crc_sql(text: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)), "
        "lambda a, b: xor(a >> 8, _t.t[xor(a, b) % 256 + 1])), 4294967295)"
    )


def _point_sql(s: int) -> str:
    p = sharding.PRIME
    x = f"((a + {(s + 1) * 1_000_003 * 97}) % {p})"
    return f"((((({x} * (({x} + b) % {p})) % {p}) * (({x} + c + {s}) % {p}) + b) % {p})"[1:]


def _shards_sql(n: int) -> str:
    least = "[" + ", ".join(_point_sql(s) for s in range(n)) + "]"
    return f"list_position({least}, list_max({least})) - 1"


@query("op1_dart_minhash")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """The class of near duplicates of every document."""
    return minhash.near_duplicates(table(spark, sf, "documents"))


#: Date of the response records that are made of ``pages``, which has none.
PAGE_DATE = "2024-01-01T00:00:00Z"


def _plain_sql(x: str) -> str:
    q = lambda s: s.replace("'", "''")
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for name in warc.DROPPED:
        x = f"regexp_replace({x}, '(?is)<{name}\\b[^>]*>.*?</{name}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:{warc.BLOCKS})\\b[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[!/?a-zA-Z][^>]*>', '', 'g')"
    for a, b in warc.ENTITIES:
        x = f"replace({x}, '{q(a)}', '{q(b)}')"
    x = f"regexp_replace({x}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _id_sql(*parts: str) -> str:
    h = f"sha256({' || chr(10) || '.join(parts)})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


@query("op2_warc_derivatives", f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages),
r AS (SELECT *, {_id_sql("'response'", "target_uri", "html")} AS refers_to, 'sha256:' || sha256(html) AS source_payload_digest,
             'Content-Type: text/html; charset=utf-8' AS h1, 'Content-Length: ' || octet_length(encode(html)) AS h2 FROM p),
b AS (SELECT *, 'sha256:' || sha256('HTTP/1.1 200 OK' || nl || h1 || nl || h2 || nl || nl || html) AS source_block_digest,
             {_id_sql("'metadata'", "refers_to")} AS meta_id, {_id_sql("'conversion'", "refers_to")} AS made_id,
             'status: 200' || nl || 'source-header: ' || h1 || nl || 'source-header: ' || h2 || nl || 'title: '
             || trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')) || nl
             || 'source-payload-digest: ' || source_payload_digest || nl AS fields FROM r),
u AS (SELECT 'metadata' AS type, meta_id AS record_id, made_id AS concurrent_to, 'application/warc-fields' AS content_type, fields AS content, * EXCLUDE (fields, html) FROM b
      UNION ALL SELECT 'conversion', made_id, meta_id, 'text/plain; charset=utf-8', {_plain_sql("html")}, * EXCLUDE (fields, html) FROM b)
SELECT page_id, type, record_id, refers_to, concurrent_to, target_uri, '{PAGE_DATE}' AS date, content_type, CAST(octet_length(encode(content)) AS BIGINT) AS content_length,
       'sha256:' || sha256(content) AS block_digest, source_block_digest, source_payload_digest, content FROM u""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.derivatives(warc.responses(table(spark, sf, "pages"), PAGE_DATE, ("page_id",)), ("page_id",))


@query("op3_rendezvous_shards", f"""
WITH {CRC_SQL.strip()},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents, _t),
r AS (SELECT *, ('0x' || substr(h, 1, 7))::BIGINT AS a, ('0x' || substr(h, 8, 7))::BIGINT AS b, ('0x' || substr(h, 15, 7))::BIGINT AS c FROM d),
s AS (SELECT *, {_shards_sql(40)} AS shard, {_shards_sql(41)} AS grown_shard, ((a + text_crc32) * 48271 + size) % {sharding.PRIME} AS place FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM s""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """All documents over 40 equal shards."""
    d = sharding.shard_documents(table(spark, sf, "documents"), [1.0] * 40)
    return d.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op4_pigeonhole_decontamination")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_concatenate_and_cut")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf, "documents")).drop("ids")


@query("op6_context_tree_weighting")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """The log probability of every document under a word model and a weighted context tree of its running text."""
    return text_tree.scored(table(spark, sf, "documents"))


#: Control strings in SQL, as in ``chat``.
_ESC = r"regexp_replace(regexp_replace(%s, '\\', '\\\\', 'g'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g')"


@query("op7_prefix_target_chat", f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
n AS (SELECT *, length({_ESC % "role"}) + length({_ESC % "text"}) + 20 AS size, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS m
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = m) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    own = spark.sql(
        "SELECT -1L AS conv_id, t AS turn, IF(t = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(array(0L, 1L)) AS t)"
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(rows.unionByName(own)))


@query("op8_random_indexing_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """A quality score of every document, learned from labels outside the held-out fifth."""
    return quality_model.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_weak_supervision_pii")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.detected(table(spark, sf, "documents"))


@query("op10_line_frequency", f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, md5(coalesce(source, '') || chr(10) || coalesce(text, '')) AS digest FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT uid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT uid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
g2 AS (SELECT uid, i FROM g QUALIFY count(*) OVER (PARTITION BY uid, win) > 1),
rep AS (SELECT uid, count(DISTINCT i + k) AS n FROM g2, range(0, 3) r(k) GROUP BY 1),
l AS (SELECT uid, host, digest, length(line) AS size,
             trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]{{2,}}|[\\x09-\\x0D]', ' ', 'g')) AS line
      FROM (SELECT uid, host, digest, unnest(lines) AS line FROM w)),
h AS (SELECT host, count(DISTINCT digest) AS texts FROM w GROUP BY 1),
o AS (SELECT host, line FROM l JOIN h USING (host) GROUP BY host, line, texts
      HAVING count(DISTINCT digest) > {quality.FLOOR} AND count(DISTINCT digest) > CAST({quality.SHARE} AS DOUBLE) * texts),
gone AS (SELECT uid, sum(size) AS gone FROM l JOIN o USING (host, line) GROUP BY 1),
whole AS (SELECT uid, sum(size) AS whole FROM l GROUP BY 1),
b AS (SELECT w.uid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone, 0) AS gone, coalesce(whole, 0) AS whole
      FROM w LEFT JOIN rep USING (uid) LEFT JOIN gone USING (uid) LEFT JOIN whole USING (uid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone <= CAST({quality.DEPLETED} AS DOUBLE) * whole AS kept FROM f""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.judged(table(spark, sf, "documents")).drop("digest", "removed")


@query("op11_strassen_hard_negatives", """
WITH e AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.uid <> c.uid),
p AS (SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.uid, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (uid) WHERE NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all vectors."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = strassen.quantised(table(spark, sf, "embeddings"), wrong)
    return strassen.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query("op12_golay_simhash")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprint of every document and its component of near fingerprints."""
    return golay.near_duplicates(table(spark, sf, "documents"))


@query("op13_qdwh_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector on the whitened leading components."""
    return whitening.whitened(table(spark, sf, "embeddings"))
