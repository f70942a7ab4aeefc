"""Registered queries on transcripts and on assembling contexts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_spark.operators import assembly as A
from recall_spark.operators import transcript as T
from recall_spark.plans.queries import query
from recall_spark.sources import views as V

#: Events as transcripts: clicks and purchases are assistants (clicks call one or two tools), views are results, others other rows.
_ROWS = """, t AS (SELECT user_id AS session, event_id AS "at", CASE event_type WHEN 'click' THEN 'assistant' WHEN 'purchase' THEN 'assistant' WHEN 'view' THEN 'result' ELSE 'other' END AS kind,
  CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN [k, CAST(CAST(k AS BIGINT) + 1 AS VARCHAR)] ELSE [k] END END AS calls, CASE WHEN event_type = 'view' THEN k END AS call_id, event_id % 11 = 0 AS failed
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)),
 s AS (SELECT *, count(*) FILTER (kind = 'assistant') OVER (PARTITION BY session ORDER BY "at") AS span FROM t),
 c AS (SELECT session, span, call_id, min(place) AS place, count(*) - 1 AS repeats FROM (SELECT session, span, unnest(calls) AS call_id, generate_subscripts(calls, 1) - 1 AS place FROM s WHERE kind = 'assistant' AND NOT failed) GROUP BY 1, 2, 3),
 a AS (SELECT *, span = min(span) OVER (PARTITION BY session, call_id) AS wins FROM c)"""


def transcript(spark, d):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "assistant").when(F.col("event_type") == "view", "result").otherwise("other")
    calls = F.when(F.col("event_type") == "click", F.when(i % 3 == 0, F.array(k, (k.cast("long") + 1).cast("string"))).otherwise(F.array(k)))
    return V.read(spark, d, "events").select(F.col("user_id").alias("session"), i.alias("at"), kind.alias("kind"), calls.alias("calls"), F.when(F.col("event_type") == "view", k).alias("call_id"), (i % 11 == 0).alias("failed"))


@query("t1_repair_transcript", "", "WITH x AS (SELECT 1)" + _ROWS + """, f AS (SELECT a.session, a.span, a.call_id, a.place, min(s."at") AS "at" FROM a LEFT JOIN s ON s.kind = 'result' AND s.session = a.session AND s.span = a.span AND s.call_id = a.call_id WHERE wins GROUP BY ALL),
 o AS (SELECT session, span, 1 AS part, place, "at", 'result' AS kind, call_id, "at" IS NULL AS made FROM f UNION ALL SELECT session, span, CASE kind WHEN 'assistant' THEN 0 ELSE 2 END, "at", "at", kind, NULL, false FROM s WHERE kind <> 'result')
 SELECT session, row_number() OVER (PARTITION BY session ORDER BY span, part, place, call_id) - 1 AS position, "at", kind, call_id, made FROM o""")
def _(spark, d):
    return T.repair(transcript(spark, d))[0]


@query("t1_repair_counters", "", "WITH x AS (SELECT 1)" + _ROWS + """, r AS (SELECT s.session, s.span, s.call_id, s."at", a.wins FROM s LEFT JOIN a USING (session, span, call_id) WHERE s.kind = 'result'),
 m AS (SELECT session, count(*) AS moved FROM (SELECT DISTINCT session, span FROM r WHERE wins) JOIN (SELECT DISTINCT session, span FROM s WHERE kind = 'other') USING (session, span) GROUP BY 1),
 g AS (SELECT session, count(*) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE r.session = a.session AND r.span = a.span AND r.call_id = a.call_id) AND wins) AS made, sum(repeats + CASE WHEN wins THEN 0 ELSE 1 END) AS extra FROM a GROUP BY 1),
 h AS (SELECT session, count(*) FILTER (wins IS NULL) AS orphans, count(*) FILTER (NOT wins) AS late FROM r GROUP BY 1)
 SELECT session, coalesce(made, 0) AS made, CAST(coalesce(extra, 0) + coalesce(late, 0) AS BIGINT) AS duplicates, coalesce(orphans, 0) AS orphans, coalesce(moved, 0) AS moved FROM (SELECT DISTINCT session FROM s) LEFT JOIN g USING (session) LEFT JOIN h USING (session) LEFT JOIN m USING (session)""")
def _(spark, d):
    return T.repair(transcript(spark, d))[1]


@query("j10_pair_in_spans", "", "WITH x AS (SELECT 1)" + _ROWS + """ SELECT a.session, min(h."at") AS called_at, a.call_id, min(r."at") AS answered_at FROM a JOIN s h ON h.kind = 'assistant' AND h.session = a.session AND h.span = a.span
 LEFT JOIN s r ON r.kind = 'result' AND r.session = a.session AND r.span = a.span AND r.call_id = a.call_id GROUP BY a.session, a.span, a.call_id""")
def _(spark, d):
    return T.pair_in_spans(transcript(spark, d))


@query("t2_drop_stale_calls", "", "WITH x AS (SELECT 1)" + _ROWS + """, c2 AS (SELECT session, "at", unnest(calls) AS call_id FROM t WHERE kind = 'assistant'), e AS (SELECT session, call_id, max("at") FILTER ("at" % 4 <> 0) AS last FROM t WHERE kind = 'result' GROUP BY 1, 2)
 SELECT session, "at", call_id FROM c2 LEFT JOIN (SELECT *, true AS has FROM e) USING (session, call_id) WHERE coalesce(last > "at", false) OR ("at" >= 6000 AND has IS NULL)""")
def _(spark, d):
    t = transcript(spark, d)
    results = t.where("kind = 'result'").select("session", "at", "call_id", (F.col("at") % 4 != 0).alias("selected"))
    return T.drop_stale_calls(t.select("session", "at", F.explode("calls").alias("call_id")), results, 6000).select("session", "at", "call_id")


# Budget, tail, and the prompt of a conversation by its number; every fifth has none.
BUDGET, TAIL, PROMPTS = 500, 2, ["the thing, there!", "einen der", "que la"]
_PROMPT = "CASE WHEN conversation_id % 5 = 4 THEN '  ' ELSE ['the', 'einen', 'que'][conversation_id % 3 + 1] END"


@query("p13_assemble_by_prompt", "messages", f""", terms AS (SELECT DISTINCT conversation_id, CASE WHEN conversation_id % 5 = 4 THEN [] WHEN conversation_id % 3 = 0 THEN ['the', 'thing', 'there'] WHEN conversation_id % 3 = 1 THEN ['einen', 'der'] ELSE ['que', 'la'] END AS asked FROM messages),
 r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS rn FROM messages), t AS (SELECT *, greatest(0, {BUDGET} - sum(token_count) FILTER (rn <= {TAIL}) OVER (PARTITION BY conversation_id)) AS room, sum(token_count) FILTER (rn > {TAIL}) OVER (PARTITION BY conversation_id) AS total FROM r),
 v AS (SELECT t.*, asked, list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda w: length(w) > 1) AS w FROM t JOIN terms USING (conversation_id)),
 k AS (SELECT *, CASE WHEN coalesce(total, 0) <= room THEN 'full-fit' WHEN len(asked) > 0 THEN 'prompt-aware' ELSE 'chronological' END AS mode, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(asked, x))) / len(w) ELSE 0 END, 6) AS score FROM v),
 o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE WHEN mode = 'prompt-aware' THEN -score ELSE 0 END, seq DESC) AS i FROM k WHERE rn > {TAIL}),
 RECURSIVE fold AS (SELECT conversation_id, seq, mode, room, i, token_count <= room AS kept, CASE WHEN token_count <= room THEN token_count ELSE 0 END AS used, mode <> 'prompt-aware' AND token_count > room AS over FROM o WHERE i = 1 UNION ALL
  SELECT o.conversation_id, o.seq, o.mode, o.room, o.i, NOT f.over AND f.used + o.token_count <= o.room, CASE WHEN NOT f.over AND f.used + o.token_count <= o.room THEN f.used + o.token_count ELSE f.used END, f.over OR (o.mode <> 'prompt-aware' AND f.used + o.token_count > o.room) FROM fold f JOIN o ON o.conversation_id = f.conversation_id AND o.i = f.i + 1)
 SELECT conversation_id, seq AS ordinal, mode FROM fold WHERE kept UNION ALL SELECT conversation_id, seq, mode FROM k WHERE rn <= {TAIL}""")
def _(spark, d):
    m = V.messages(spark, d).select("conversation_id", F.col("seq").alias("ordinal"), "token_count", "content")
    c = F.col("conversation_id")
    prompts = m.select("conversation_id").distinct().withColumn("prompt", F.when(c % 5 == 4, "  ").otherwise(F.element_at(F.array(*map(F.lit, PROMPTS)), (c % 3 + 1).cast("int"))))
    return A.assemble(m, prompts, TAIL, BUDGET).select("conversation_id", "ordinal", "mode")
