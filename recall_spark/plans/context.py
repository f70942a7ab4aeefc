"""Registered queries on compaction steps, rendering, file references, cache keys and evaluation reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_spark.functions.text import band
from recall_spark.operators import context as C
from recall_spark.operators import windows as W
from recall_spark.plans.queries import _PACK, _RAW, query
from recall_spark.sources import views as V

_CHUNKS = _RAW + _PACK.format(src="raw", b=100)


def _chunks(spark, d):
    return W.plan_leaf_chunks(V.context_items(spark, d), 2, 100)


@query("j6_covered_only_by", "items", _CHUNKS + ", l AS (SELECT conversation_id, ordinal, chunk AS leaf FROM p UNION SELECT conversation_id, ordinal, 1 FROM p WHERE ordinal % 3 = 0) SELECT conversation_id, ordinal FROM l GROUP BY 1, 2 HAVING bool_and(leaf % 2 = 0)")
def _(spark, d):
    p = _chunks(spark, d)
    links = p.select("conversation_id", "ordinal", F.col("chunk").cast("long").alias("leaf")).union(p.where("ordinal % 3 = 0").select("conversation_id", "ordinal", F.lit(1).cast("long"))).distinct()
    return C.covered_only_by(links, links.where("leaf % 2 = 0").select("conversation_id", "leaf").distinct())


@query("p2_next_leaf_chunk", "items", _CHUNKS + " SELECT conversation_id, ordinal FROM p WHERE chunk = 0")
def _(spark, d):
    return C.next_leaf_chunk(_chunks(spark, d)).select("conversation_id", "ordinal")


@query("p7_fallback_summary", "summaries", f""", t AS (SELECT summary_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS x FROM summaries)
 SELECT summary_id, sha256(CASE WHEN coalesce(x, '') = '' THEN '' WHEN length(x) <= 400 THEN '{C.FALLBACK_WHOLE}' || chr(10) || x ELSE '{C.FALLBACK_CUT}' || chr(10) || substring(x, 1, 400) END) AS text_hash FROM t""")
def _(spark, d):
    return V.summaries(spark, d).select("summary_id", F.sha2(C.fallback_summary("content", 100), 256).alias("text_hash"))


@query("p9_replace_ranges", "items", _CHUNKS + """, g AS (SELECT conversation_id, chunk, min(ordinal) AS first, max(ordinal) AS last FROM p GROUP BY 1, 2), a AS (
 SELECT conversation_id, ordinal, 'm' || message_id AS ref FROM items WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.conversation_id = items.conversation_id AND items.ordinal BETWEEN first AND last)
 UNION ALL SELECT conversation_id, first, 's' || chunk FROM g) SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS ordinal, ref FROM a""")
def _(spark, d):
    ranges = _chunks(spark, d).groupBy("conversation_id", "chunk").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).withColumn("summary", F.concat(F.lit("s"), "chunk"))
    items = V.context_items(spark, d).select("conversation_id", "ordinal", F.concat(F.lit("m"), "message_id").alias("ref"))
    return C.replace_ranges(items, ranges.select("conversation_id", "first", "last", "summary"))


@query("p16_render_summary", "tree", """, r AS (SELECT summary_id, string_agg('    <summary_ref id="' || source_summary_id || '" />', chr(10) ORDER BY ordinal) AS refs, count(*) AS n FROM edges GROUP BY 1)
 SELECT n.summary_id, '<summary id="' || n.summary_id || '" kind="' || CASE WHEN depth > 0 THEN 'condensed' ELSE 'leaf' END || '" depth="' || depth || '" descendant_count="' || coalesce(r.n, 0) || '">' || chr(10)
 || CASE WHEN depth > 0 AND refs IS NOT NULL THEN '  <parents>' || chr(10) || refs || chr(10) || '  </parents>' || chr(10) ELSE '' END || '  <content>' || chr(10) || 'text of ' || n.summary_id || chr(10) || '  </content>' || chr(10) || '</summary>' AS rendered
 FROM nodes n LEFT JOIN r USING (summary_id)""")
def _(spark, d):
    nodes, edges = V.tree(spark, d)
    counted = nodes.join(edges.groupBy("summary_id").agg(F.count("*").alias("n")), "summary_id", "left")
    kind = F.when(F.col("depth") > 0, "condensed").otherwise("leaf")
    return C.render_summary(counted.select("summary_id", kind.alias("kind"), "depth", F.coalesce("n", F.lit(0)).alias("descendants"), F.concat(F.lit("text of "), "summary_id").alias("content")), edges)


@query("u9_latest_bindings", "", """SELECT user_id, event_type, CAST(epoch_us(ts) AS BIGINT) AS at, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS active FROM events""")
def _(spark, d):
    e = V.read(spark, d, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return C.latest_bindings(e, "user_id", ["at", "event_id"]).drop("event_id")


@query("e12_file_ids", "messages", """, x AS (SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'see FILE_' || substring(sha256(role), 1, 16) || ', file_' || substring(sha256(content), 1, 16) || ' and file_' || substring(sha256(role), 1, 16) ELSE content || ' file_12' END AS t, sha256(role) AS r, sha256(content) AS c FROM messages)
 SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'file_' || substring(r, 1, 16) || CASE WHEN r <> c THEN '+file_' || substring(c, 1, 16) ELSE '' END ELSE '' END AS ids FROM x""")
def _(spark, d):
    part = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    text = F.when(F.col("message_id") % 2 == 0, F.concat(F.lit("see FILE_"), part("role"), F.lit(", file_"), part("content"), F.lit(" and file_"), part("role"))).otherwise(F.concat("content", F.lit(" file_12")))
    return V.messages(spark, d).select("message_id", F.array_join(C.file_ids(text), "+").alias("ids"))


@query("y2_tighten", "", """SELECT o_orderkey, greatest(o_orderdate, DATE '1995-01-01') AS low, least(o_orderdate + INTERVAL 90 DAY, DATE '1996-06-30') AS high, greatest(o_orderdate, DATE '1995-01-01') < least(o_orderdate + INTERVAL 90 DAY, DATE '1996-06-30') AS any_left FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders)""".replace("least(o_orderdate + INTERVAL 90 DAY", "least(CAST(o_orderdate + INTERVAL 90 DAY AS DATE)"))
def _(spark, d):
    at = F.to_date("o_orderdate")
    low, high, some = C.tighten([at, F.lit("1995-01-01").cast("date")], [F.date_add(at, 90), F.lit("1996-06-30").cast("date")])
    return V.read(spark, d, "orders").select("o_orderkey", low.alias("low"), high.alias("high"), some.alias("any_left"))


@query("y6_cache_misses", "convs", """, r AS (SELECT DISTINCT session_key, conversation_id % 4 AS tier FROM convs) SELECT session_key, tier FROM r WHERE NOT EXISTS (SELECT 1 FROM convs c WHERE active = 1 AND c.session_key IS NOT DISTINCT FROM r.session_key AND c.conversation_id % 4 = r.tier)""")
def _(spark, d):
    keys = V.conversations(spark, d).select("session_key", (F.col("conversation_id") % 4).alias("tier"), "active")
    return C.cache_misses(keys.drop("active"), keys.where("active = 1"), ["session_key", "tier"])


@query("y7_resolve_session_key", "convs", " SELECT conversation_id, coalesce(CASE WHEN conversation_id % 4 = 0 THEN 'target' END, CASE WHEN conversation_id % 4 = 1 THEN 'given' END, session_key, 'main') AS resolved FROM convs")
def _(spark, d):
    k = F.col("conversation_id") % 4
    resolved = C.resolve_session_key(F.when(k == 0, " target "), F.when(k == 1, "given").otherwise("  "), F.col("session_key"), "main")
    return V.conversations(spark, d).select("conversation_id", resolved.alias("resolved"))


_RUNS = "a AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 9 > 0 THEN lang END AS stratum, doc_id % 5 / 4.0 AS recall FROM documents), b AS (SELECT doc_id AS query_id, (doc_id % 7) / 6.0 AS recall FROM documents WHERE doc_id % 3 > 0)"


@query("v3_recall_lift", "", f"WITH {_RUNS} SELECT coalesce(stratum, 'unknown') AS stratum, round(avg(a.recall), 6) AS recall_a, round(avg(b.recall), 6) AS recall_b, round(avg(b.recall) - avg(a.recall), 6) AS lift FROM a JOIN b USING (query_id) GROUP BY 1")
def _(spark, d):
    q = V.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("stratum"))
    lift = C.recall_lift(q.withColumn("recall", F.col("query_id") % 5 / 4), q.where("query_id % 3 > 0").withColumn("recall", F.col("query_id") % 7 / 6))
    return lift.select("stratum", *[F.round(c, 6).alias(c) for c in ("recall_a", "recall_b", "lift")])


@query("v4_quality_report", "", "SELECT source, round(avg(quality), 6) AS mean_score, count(quality) AS scored, count(*) - count(quality) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, d):
    scores = V.read(spark, d, "documents").join(V.read(spark, d, "labels"), "doc_id", "left").select("source", F.col("quality").alias("score"))
    return C.quality_report(scores, "source").withColumn("mean_score", F.round("mean_score", 6))


@query("a7_hit_band", "", """WITH x AS (SELECT o_orderkey AS hit, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 100.0 END AS c, CASE WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 50) / 50.0 END AS r FROM orders), y AS (SELECT *, coalesce(c, r) AS v FROM x)
 SELECT hit, CASE WHEN v IS NULL THEN 'no-match' WHEN v >= 0.65 THEN 'high' WHEN v >= 0.5 THEN 'medium' WHEN v >= 0.35 THEN 'low' ELSE 'noise' END AS band, CASE WHEN c IS NOT NULL THEN 'cosine' WHEN r IS NOT NULL THEN 'rerank' END AS band_source FROM y""")
def _(spark, d):
    k = F.col("o_orderkey")
    found, source = C.hit_band(F.when(k % 3 == 0, k % 100 / 100), F.when(k % 3 == 1, k % 50 / 50), band)
    return V.read(spark, d, "orders").select(k.alias("hit"), found.alias("band"), source.alias("band_source"))
