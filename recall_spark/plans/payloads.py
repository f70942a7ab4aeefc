"""Registered queries on payloads and nested content made from the given tables, each with SQL that follows from how they were made."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_spark.operators import payloads as P
from recall_spark.plans.queries import query
from recall_spark.sources import views as V


def loaded(spark, d):
    """Documents as messages; of each four one ends with itself as a data URI, one as a bare base64 run, one with a ruled line."""
    coded, k = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", ""), F.col("doc_id") % 4
    tail = F.when(k == 0, F.concat(F.lit(" data:text/plain;base64,"), coded, F.lit(" end"))).when(k == 1, F.concat(F.lit(" "), coded, F.lit("."))).when(k == 2, F.lit(" " + "-=" * 3000)).otherwise("")
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("message_id"), F.expr("cast(substring(source, 4) as bigint)").alias("conversation_id"), F.concat("text", tail).alias("content"))


_LOADED = """WITH b AS (SELECT doc_id AS message_id, CAST(substring(source, 4) AS BIGINT) AS conversation_id, text, to_base64(encode(text)) AS c FROM documents),
 w AS (SELECT *, CASE WHEN message_id % 4 = 0 AND length(c) >= 256 THEN 'data:text/plain;base64,' || c WHEN message_id % 4 = 1 AND length(c) >= 4096 AND len(list_distinct(string_split(rtrim(c, '='), ''))) >= 8 THEN c END AS payload FROM b),
 p AS (SELECT *, 'file_' || substring(sha256(payload), 1, 16) AS file_id FROM w)"""


@query("e6_guard_messages", "", _LOADED + """ SELECT message_id, sha256(text || CASE message_id % 4 WHEN 0 THEN ' ' || coalesce('[payload ' || file_id || ']', 'data:text/plain;base64,' || c) || ' end' WHEN 1 THEN ' ' || coalesce('[payload ' || file_id || ']', c) || '.'
  WHEN 2 THEN ' ' || repeat('-=', 3000) ELSE '' END) AS content_hash FROM p""")
def _(spark, d):
    return P.guard(loaded(spark, d))[0].select("message_id", F.sha2("content", 256).alias("content_hash"))


@query("s6_conversation_payloads", "", _LOADED + """ SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY first, file_id) AS position, file_id, n_chars, n_messages
 FROM (SELECT conversation_id, file_id, min(message_id) AS first, max(length(payload)) AS n_chars, count(*) AS n_messages FROM p WHERE payload IS NOT NULL GROUP BY 1, 2)""")
def _(spark, d):
    _, links, stored = P.guard(loaded(spark, d))
    return P.conversation_payloads(links, stored)


@query("s6_restore_messages", "", "WITH b AS (SELECT doc_id AS message_id, text, to_base64(encode(text)) AS c FROM documents) SELECT message_id, sha256(text || CASE message_id % 4 WHEN 0 THEN ' data:text/plain;base64,' || c || ' end' WHEN 1 THEN ' ' || c || '.' WHEN 2 THEN ' ' || repeat('-=', 3000) ELSE '' END) AS content_hash FROM b")
def _(spark, d):
    m, _, stored = P.guard(loaded(spark, d))
    return P.restore(m, stored).select("message_id", F.sha2("content", 256).alias("content_hash"))


def structured(spark, d):
    """Messages as JSON: text, reasoning, a tool result with nested text, an attachment with a caption; every third stays as it is."""
    block = lambda **k: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in k.items()])
    blocks = [block(type="text", text=F.col("content")), block(type="thinking", text="not this"), block(type="tool_result", call_id=F.concat(F.lit("c"), "seq"), name="look", content=F.array(block(type="text", text=F.col("role"))), output=F.col("seq")), block(type="image", alt="a picture", content=F.array(block(text="nor this")))]
    made = F.concat(F.lit("["), F.concat_ws(",", *map(F.to_json, blocks)), F.lit("]"))
    return V.messages(spark, d).withColumn("content", F.when(F.col("message_id") % 3 == 0, F.col("content")).otherwise(made))


# Lines without blanks at their ends, blank ones gone, the whole trimmed.
_PLAIN = "regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda s: regexp_replace(s, '\\s+$', '')), lambda s: s <> ''), chr(10)), '^\\s+|\\s+$', '', 'g')"


@query("e8_meaningful_text", "messages", f" SELECT message_id, sha256(CASE WHEN message_id % 3 = 0 THEN {_PLAIN} ELSE concat_ws(chr(10), nullif({_PLAIN}, ''), role, 'a picture') END) AS text_hash FROM messages")
def _(spark, d):
    return P.meaningful_text(structured(spark, d)).select("message_id", F.sha2("text", 256).alias("text_hash"))


@query("e10_message_parts", "messages", """ SELECT message_id, 0 AS ordinal, 'text' AS part_type, sha256(content) AS text_hash, NULL AS tool_call_id, NULL AS tool_name, NULL AS tool_output FROM messages UNION ALL
 SELECT message_id, 1, 'text', sha256('not this'), NULL, NULL, NULL FROM messages WHERE message_id % 3 <> 0 UNION ALL SELECT message_id, 2, 'tool', NULL, 'c' || seq, 'look', CAST(seq AS VARCHAR) FROM messages WHERE message_id % 3 <> 0
 UNION ALL SELECT message_id, 3, 'text', NULL, NULL, NULL, NULL FROM messages WHERE message_id % 3 <> 0""")
def _(spark, d):
    return P.message_parts(structured(spark, d)).select("message_id", "ordinal", "part_type", F.sha2("text_content", 256).alias("text_hash"), "tool_call_id", "tool_name", "tool_output")


@query("e7_strip_media", "messages", f" SELECT message_id, sha256({_PLAIN} || CASE WHEN seq % 2 = 0 THEN chr(10) || '[embedded media omitted]' ELSE '' END) AS text_hash FROM messages")
def _(spark, d):
    more = F.when(F.col("seq") % 2 == 0, F.lit("\nMEDIA:/tmp/a.png\n" + "QUJD" * 80 + "\ndata:image/png;base64,QUJDRA== ")).otherwise("\n \n")
    return V.messages(spark, d).select("message_id", F.sha2(P.strip_media(F.concat("content", more)), 256).alias("text_hash"))
