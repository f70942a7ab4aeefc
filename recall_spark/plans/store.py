"""Registered queries on resolution, worklists, status, entities, repairs and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_spark.operators import integrity as I
from recall_spark.operators import records as R
from recall_spark.operators import search as S
from recall_spark.operators import windows as W
from recall_spark.functions import text as T
from recall_spark.functions.text import words
from recall_spark.operators import postings as N
from recall_spark.plans.queries import _BM25, _BM25_DOCS, _ENTITIES, _KNN, _PACK, _RAW, NOW, RULES, _bm25, _bm25_docs, _knn, bm25_sql, query
from recall_spark.sources import views as V

BM = _BM25.lstrip(", ")


def _mentions(spark, d):
    s = V.summaries(spark, d).where("suppressed_at is null")
    return I.extract_entities(s, RULES, ("created_at",)).distinct()


_SEEN = ", visible AS (SELECT * FROM summaries WHERE suppressed_at IS NULL)" + _ENTITIES.replace("FROM summaries", "FROM visible") + ", m AS (SELECT DISTINCT f.*, created_at FROM f JOIN visible USING (summary_id))"


def _mixed(spark, d):
    """Messages and, behind them, summaries as context items; every 17th reference leads nowhere."""
    a = V.messages(spark, d).select("conversation_id", F.col("seq").alias("ordinal"), F.when(F.col("message_id") % 17 == 0, -1).otherwise(F.col("message_id")).alias("message_id"), F.lit(None).cast("string").alias("summary_id"))
    b = V.summaries(spark, d).select("conversation_id", (F.col("doc_id") + 1000).alias("ordinal"), F.lit(None).cast("long").alias("message_id"), F.when(F.col("doc_id") % 17 == 0, "none").otherwise(F.col("summary_id")).alias("summary_id"))
    return a.union(b)


_MIXED = """, mixed AS (SELECT conversation_id, seq AS ordinal, CASE WHEN message_id % 17 = 0 THEN -1 ELSE message_id END AS message_id, NULL AS summary_id FROM messages UNION ALL
 SELECT conversation_id, doc_id + 1000, NULL, CASE WHEN doc_id % 17 = 0 THEN 'none' ELSE summary_id END FROM summaries)"""
_CHUNKS = _RAW + _PACK.format(src="raw", b=100)


def _chunks(spark, d):
    return W.plan_leaf_chunks(V.context_items(spark, d), 2, 100)


@query("f2_resolve_scope", "convs", """ SELECT conversation_id AS request_id, CASE conversation_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'all' ELSE CASE WHEN session_key IS NOT NULL THEN 'family' ELSE 'session' END END AS scope,
 CASE conversation_id % 4 WHEN 0 THEN CAST(conversation_id AS VARCHAR) WHEN 1 THEN NULL ELSE coalesce(session_key, session_id) END AS value FROM convs""")
def _(spark, d):
    k = F.col("conversation_id") % 4
    return R.resolve_scope(V.conversations(spark, d).select(F.col("conversation_id").alias("request_id"), F.when(k == 0, F.col("conversation_id")).alias("conversation_id"), (k == 1).alias("everything"), "session_key", "session_id"))


@query("f11_match_names", "summaries", _SEEN + " SELECT DISTINCT lower(surface) AS entity, CASE WHEN lower(surface) = 'an' THEN 'exact' WHEN starts_with(lower(surface), 'an') THEN 'prefix' ELSE 'substring' END AS how FROM m WHERE contains(lower(surface), 'an')")
def _(spark, d):
    return R.match_names(_mentions(spark, d).select(F.lower("surface").alias("entity")).distinct(), "entity", "An")


@query("j1_resolve_items", "messages summaries", _MIXED + """ SELECT x.conversation_id, x.ordinal, CASE WHEN x.message_id IS NOT NULL THEN 'message' ELSE 'summary' END AS item_type, coalesce(m.token_count, s.token_count) AS token_count
 FROM mixed x LEFT JOIN messages m ON m.message_id = x.message_id LEFT JOIN summaries s ON s.summary_id = x.summary_id WHERE m.message_id IS NOT NULL OR s.summary_id IS NOT NULL""")
def _(spark, d):
    return R.resolve_items(_mixed(spark, d), V.messages(spark, d), V.summaries(spark, d)).drop("content")


@query("j2_covering_leaves", "items messages", _CHUNKS + " SELECT p.conversation_id, p.chunk, min(p.ordinal) AS first_hit FROM p JOIN messages m ON m.conversation_id = p.conversation_id AND m.seq = p.ordinal WHERE contains(m.content, 'the') GROUP BY 1, 2")
def _(spark, d):
    hits = V.messages(spark, d).where(F.contains("content", F.lit("the"))).select("conversation_id", F.col("seq").alias("ordinal"))
    return R.covering_leaves(hits, _chunks(spark, d))


@query("j4_collectable", "items", _CHUNKS + " SELECT items.message_id FROM items JOIN p ON p.conversation_id = items.conversation_id AND p.ordinal = items.ordinal WHERE items.role = 'assistant' AND items.ordinal % 3 <> 0")
def _(spark, d):
    items = V.context_items(spark, d)
    return R.collectable(items, _chunks(spark, d), items.where("ordinal % 3 = 0"), "assistant").select("message_id")


@query("j5_pending_extractions", "summaries", """ SELECT summary_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY created_at, summary_id) AS rank FROM summaries
 WHERE suppressed_at IS NULL AND doc_id % 4 <> 0 AND doc_id % 7 < 5) WHERE rank <= 20""")
def _(spark, d):
    s = V.summaries(spark, d)
    jobs = s.select("summary_id", (F.col("doc_id") % 4 == 0).alias("done"), (F.col("doc_id") % 7).alias("attempts"))
    return R.pending_extractions(s, jobs, 20).select("summary_id", "rank")


@query("j7_previous_summary", "summaries", " SELECT summary_id, lag(summary_id) OVER (PARTITION BY conversation_id, depth ORDER BY created_at, summary_id) AS previous FROM summaries")
def _(spark, d):
    return V.summaries(spark, d).select("summary_id", R.previous(None, ["conversation_id", "depth"], ["created_at", "summary_id"], "summary_id").alias("previous"))


@query("j8_prior_context", "summaries", """, x AS (SELECT summary_id, sha256(content) AS h, conversation_id, created_at FROM summaries)
 SELECT summary_id, concat_ws('+', lag(h, 2) OVER w, lag(h) OVER w) AS prior FROM x WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, summary_id)""")
def _(spark, d):
    s = V.summaries(spark, d).withColumn("h", F.sha2("content", 256))
    before = lambda n: R.previous(None, ["conversation_id"], ["created_at", "summary_id"], "h", n)
    return s.select("summary_id", F.concat_ws("+", before(2), before(1)).alias("prior"))


@query("j9_orphans", "tree", " SELECT summary_id FROM nodes WHERE summary_id NOT IN (SELECT source_summary_id FROM edges WHERE ordinal <> 3) AND summary_id NOT IN (SELECT summary_id FROM nodes WHERE depth = 3)")
def _(spark, d):
    nodes, edges = V.tree(spark, d)
    return R.orphans(nodes, edges.where("ordinal <> 3"), nodes.where("depth = 3")).select("summary_id")


@query("j10_pair_calls", "", """WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS call_id, event_type, ts FROM events), c AS (SELECT user_id, call_id, min(ts) AS called_at FROM e WHERE event_type = 'click' GROUP BY 1, 2)
 SELECT c.user_id, c.call_id, CAST(floor(epoch(called_at)) AS BIGINT) AS called_at, CAST(floor(epoch(min(e.ts))) AS BIGINT) AS answered_at FROM c LEFT JOIN e ON e.user_id = c.user_id AND e.call_id = c.call_id AND e.event_type = 'view' AND e.ts > c.called_at GROUP BY 1, 2, 3""")
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "result")
    e = V.read(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("call_id"), kind.alias("kind"), F.col("ts").alias("at"))
    seconds = lambda c: F.floor(F.col(c).cast("timestamp").cast("double")).cast("long").alias(c)
    return R.pair_calls(e, ["user_id", "call_id"]).select("user_id", "call_id", seconds("called_at"), seconds("answered_at"))


@query("g4_depths_before", "tree", " SELECT DISTINCT k.k // 4 AS family, depth FROM ids k WHERE k.k % 4 < 3")
def _(spark, d):
    nodes, _ = V.tree(spark, d)
    k = F.element_at(F.split("summary_id", "_"), -1).cast("long")
    return nodes.where(k % 4 < 3).select(F.floor(k / 4).alias("family"), "depth").distinct()


_METRICS = """, a AS (SELECT conversation_id, count(*) AS n_messages, CAST(sum(token_count) AS BIGINT) AS context_tokens FROM messages GROUP BY 1), b AS (SELECT conversation_id, count(*) AS n_summaries, CAST(sum(token_count) AS BIGINT) AS compressed_tokens, count(suppressed_at) AS n_hidden FROM summaries GROUP BY 1),
 z AS (SELECT conversation_id, coalesce(n_messages, 0) AS n_messages, coalesce(context_tokens, 0) AS context_tokens, coalesce(n_summaries, 0) AS n_summaries, coalesce(compressed_tokens, 0) AS compressed_tokens, coalesce(n_hidden, 0) AS n_hidden FROM a FULL JOIN b USING (conversation_id))"""


@query("g6_conversation_status", "messages summaries", _METRICS + " SELECT conversation_id, context_tokens, compressed_tokens, context_tokens > compressed_tokens AS larger FROM z")
def _(spark, d):
    return R.conversation_metrics(V.messages(spark, d), V.summaries(spark, d)).select("conversation_id", "context_tokens", "compressed_tokens", (F.col("context_tokens") > F.col("compressed_tokens")).alias("larger"))


@query("g19_conversation_metrics", "messages summaries", _METRICS + " SELECT * FROM z")
def _(spark, d):
    return R.conversation_metrics(V.messages(spark, d), V.summaries(spark, d))


@query("g8_entity_summary", "summaries", _SEEN + " SELECT lower(surface) AS entity, count(*) AS occurrences, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT session_key) AS n_sessions, min(type) AS type FROM m GROUP BY 1")
def _(spark, d):
    return R.entity_summary(_mentions(spark, d))


@query("g9_newest_mentions", "summaries", _SEEN + " SELECT entity, summary_id, surface, rank FROM (SELECT lower(surface) AS entity, summary_id, surface, row_number() OVER (PARTITION BY lower(surface) ORDER BY created_at DESC, summary_id, surface, type) AS rank FROM m) WHERE rank <= 3")
def _(spark, d):
    m = _mentions(spark, d).withColumn("entity", F.lower("surface"))
    return R.first_by(m, ["entity"], [F.desc("created_at"), F.asc("summary_id"), F.asc("surface"), F.asc("type")], 3).select("entity", "summary_id", "surface", "rank")


@query("g10_browse_entities", "summaries", _SEEN + """, e AS (SELECT lower(surface) AS entity, count(*) AS occurrences, max(created_at) AS last_seen, min(type) AS type FROM m GROUP BY 1)
 SELECT type, entity, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY occurrences DESC, last_seen DESC, entity) AS rank FROM e) WHERE rank <= 10""")
def _(spark, d):
    return R.first_by(R.entity_summary(_mentions(spark, d)), ["type"], [F.desc("occurrences"), F.desc("last_seen"), F.asc("entity")], 10).select("type", "entity", "rank")


@query("g11_alternate_surfaces", "summaries", _SEEN + ", o AS (SELECT DISTINCT lower(surface) AS entity, CASE WHEN ends_with(summary_id, '5') THEN upper(surface) ELSE surface END AS surface FROM m) SELECT entity, min(surface) AS canonical, string_agg(surface, ',' ORDER BY surface) AS surfaces FROM o GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return R.alternate_surfaces(_mentions(spark, d).withColumn("surface", F.when(F.endswith("summary_id", F.lit("5")), F.upper("surface")).otherwise(F.col("surface"))))


@query("g12_catalogue_coverage", "convs summaries", _SEEN + ", k AS (SELECT DISTINCT session_key FROM summaries UNION SELECT DISTINCT session_key FROM convs WHERE session_key IS NOT NULL) SELECT session_key, CASE WHEN session_key IN (SELECT session_key FROM m) THEN 'active' ELSE 'empty_for_session' END AS state FROM k")
def _(spark, d):
    keys = V.summaries(spark, d).select("session_key").union(V.conversations(spark, d).where("session_key is not null").select("session_key")).distinct()
    return R.catalogue_coverage(keys, _mentions(spark, d))


@query("g13_entity_types", "summaries", _SEEN + " SELECT type, count(*) AS n_mentions, count(DISTINCT lower(surface)) AS n_entities FROM m GROUP BY 1")
def _(spark, d):
    return _mentions(spark, d).groupBy("type").agg(F.count("*").alias("n_mentions"), F.countDistinct(F.lower("surface")).alias("n_entities"))


@query("g14_leaf_metadata", "items messages", _CHUNKS + " SELECT p.conversation_id, p.chunk, min(created_at) AS first_at, max(created_at) AS last_at, CAST(sum(m.token_count) AS BIGINT) AS source_tokens FROM p JOIN messages m ON m.conversation_id = p.conversation_id AND m.seq = p.ordinal GROUP BY 1, 2")
def _(spark, d):
    lined = _chunks(spark, d).join(V.messages(spark, d).withColumnRenamed("seq", "ordinal"), ["conversation_id", "ordinal"])
    return lined.groupBy("conversation_id", "chunk").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.sum("token_count").alias("source_tokens"))


@query("g16_embedding_health", "summaries", """, x AS (SELECT s.*, s.summary_id IN (SELECT 'sum_' || vec_id FROM embeddings WHERE vec_id % 4 <> 0) AS has FROM summaries s) SELECT count(*) FILTER (suppressed_at IS NULL AND has) AS embedded, count(*) FILTER (suppressed_at IS NULL AND NOT has AND token_count BETWEEN 20 AND 800) AS pending,
 count(*) FILTER (suppressed_at IS NULL AND token_count > 800) AS over_cap, count(suppressed_at) AS suppressed FROM x""")
def _(spark, d):
    done = V.read(spark, d, "embeddings").where("vec_id % 4 <> 0").select(F.concat(F.lit("sum_"), "vec_id").alias("summary_id"))
    return R.embedding_health(V.summaries(spark, d), done, 20, 800)


@query("w8_latest_prompt", "", "SELECT event_type, tier, max_by(event_id, (ts, event_id)) AS prompt_id FROM (SELECT *, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS tier FROM events WHERE event_id % 5 <> 0) GROUP BY 1, 2")
def _(spark, d):
    e = V.read(spark, d, "events").where("event_id % 5 <> 0").withColumn("tier", F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3))
    return e.groupBy("event_type", "tier").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("prompt_id"))


@query("w9_register_version", "", """WITH v AS (SELECT user_id, CAST(count(*) AS BIGINT) AS version FROM events GROUP BY 1), n AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0 UNION SELECT -1)
 SELECT user_id, version, user_id % 2 <> 0 AS active FROM v UNION ALL SELECT n.user_id, coalesce(v.version, 0) + 1, true FROM n LEFT JOIN v USING (user_id)""")
def _(spark, d):
    e = V.read(spark, d, "events")
    versions = e.groupBy("user_id").agg(F.count("*").alias("version")).withColumn("active", F.lit(True))
    new = e.where("user_id % 2 = 0").select("user_id").union(spark.range(1).select(F.lit(-1).cast("long")))
    return R.register_version(versions, new, ["user_id"])


@query("w10_prior_run", "", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior_id FROM events")
def _(spark, d):
    return V.read(spark, d, "events").select("event_id", R.previous(None, ["user_id", "event_type"], ["ts", "event_id"], "event_id").alias("prior_id"))


@query("w11_active_profile", "convs", " SELECT coalesce(session_key, session_id) AS profile, max(conversation_id) AS newest FROM convs WHERE active = 1 GROUP BY 1")
def _(spark, d):
    return V.conversations(spark, d).where("active = 1").groupBy(F.coalesce("session_key", "session_id").alias("profile")).agg(F.max("conversation_id").alias("newest"))


def _ordered(mode, order):
    sql = f"WITH {BM} SELECT query_id, doc_id, score FROM bm WHERE rank <= 10 ORDER BY {order} LIMIT 12"

    def run(spark, d):
        hits = _bm25(spark, d).select("query_id", "doc_id", "score", F.expr(f"timestampadd(MINUTE, cast(doc_id as int), {V.START})").alias("created_at"))
        return S.order_hits(hits.dropDuplicates(["doc_id"]) if mode == "recency" else hits, "doc_id", mode, NOW, 12).select("query_id", "doc_id", "score")

    return sql, run


_sql, _run = _ordered("relevance", "-score, doc_id DESC")
query("k2_relevance", "", _sql)(_run)


@query("k1_recency", "summaries", " SELECT summary_id FROM summaries WHERE contains(content, 'there') ORDER BY created_at DESC, summary_id LIMIT 25")
def _(spark, d):
    hits = V.summaries(spark, d).where(F.contains("content", F.lit("there"))).select("summary_id", F.lit(0.0).alias("score"), "created_at")
    return S.order_hits(hits, "summary_id", "recency", NOW, 25).select("summary_id")


@query("k5_cap_body", "", "SELECT doc_id, length(text) > 5000 AS truncated, sha256(substring(text, 1, 5000)) AS body FROM documents")
def _(spark, d):
    return R.cap_body(V.read(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "truncated", F.sha2("text", 256).alias("body"))


@query("k6_page", "messages", " SELECT message_id, seq FROM messages WHERE message_id > 100000 ORDER BY message_id LIMIT 50")
def _(spark, d):
    return R.page(V.messages(spark, d), "message_id", 100000, 50).select("message_id", "seq")


@query("k8_merge_hits", "", "WITH" + _KNN + "," + _BM25_DOCS.lstrip(", ") + """ SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.vec_id) AS doc_id, CASE WHEN b.vec_id IS NULL THEN 'text' WHEN a.doc_id IS NULL THEN 'vector' ELSE 'both' END AS source
 FROM (SELECT * FROM bm WHERE rank <= 10) a FULL JOIN (SELECT * FROM nn WHERE rank <= 10) b ON a.query_id = b.query_id AND a.doc_id = b.vec_id""")
def _(spark, d):
    vec = _knn(spark, d).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return R.merge_hits(_bm25_docs(spark, d), vec, "doc_id").select("query_id", "doc_id", "source")


@query("x2_search_messages", "messages", bm25_sql("SELECT message_id AS query_id, content AS text FROM messages WHERE message_id % 50 = 0", "SELECT message_id AS doc_id, content AS text FROM messages") + " SELECT query_id, doc_id AS message_id, rank, score FROM bm WHERE rank <= 10")
def _(spark, d):
    m = V.messages(spark, d)
    queries = m.where("message_id % 50 = 0").select(F.col("message_id").alias("query_id"), words("content").alias("terms"))
    return N.ranked(N.index_words(m, "message_id", "content", places=False), queries, 10)


@query("x4_phrases", "", """WITH q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS x FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
 SELECT query_id, doc_id FROM q JOIN t ON contains(x, ' ' || array_to_string(w, ' ') || ' ') WHERE len(w) > 0""")
def _(spark, d):
    from recall_spark.plans.queries import asked, index

    queries = asked(spark, d)
    return N.phrases(index(spark, d, places=True, asked=queries), queries).select("query_id", "doc_id")


# Fixed value: stand-ins for letters, since the given tables have no CJK text.
_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上个国和也子时道说出而要"
_CJK = f"translate(lower({{c}}), '{_LETTERS}', '{_SIGNS}')"


def _cjk(size, least):
    windows = f"CASE WHEN length(s) <= {size} THEN [s] ELSE list_transform(range(1, length(s) - {size} + 2), lambda i: substring(s, i, {size})) END"
    sql = f"""WITH t AS (SELECT doc_id, {_CJK.format(c="text")} || ' ' || source AS x FROM documents), q AS (SELECT n_nationkey AS query_id, list_filter(regexp_split_to_array({_CJK.format(c="n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' thing' ELSE ' ing' END")}, '[^{_SIGNS}]+'), lambda s: length(s) >= {least}) AS segs, 'src' || (n_nationkey % 3) AS latin FROM nation)
 SELECT CAST(query_id AS BIGINT) AS query_id, doc_id FROM q JOIN t ON contains(x, latin) AND contains(x, CAST(query_id AS VARCHAR)) WHERE len(segs) > 0 AND len(list_filter(segs, lambda s: len(list_filter({windows}, lambda w: contains(x, w))) > 0)) = len(segs)"""

    def run(spark, d):
        docs = V.read(spark, d, "documents").select("doc_id", F.concat(F.expr(_CJK.format(c="text")), F.lit(" "), "source").alias("text"))
        queries = V.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.expr(_CJK.format(c="n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' thing' ELSE ' ing' END")), F.lit(" src"), F.col("n_nationkey") % 3).alias("text"))
        return N.search_cjk(N.index_cjk(docs, "doc_id", "text"), docs, "doc_id", "text", queries, size)

    return sql, run


for _name, _size, _least in (("x9_cjk_windows", 4, 3), ("x10_cjk_pairs", 2, 1)):
    _sql, _run = _cjk(_size, _least)
    query(_name, "", _sql)(_run)


@query("x12_verbatim", "messages", " SELECT message_id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS rank FROM messages WHERE contains(content, 'in') AND role = 'user') WHERE rank <= 20")
def _(spark, d):
    return R.verbatim(V.messages(spark, d), "in", "user", 20).select("message_id", "role", "content")


@query("x13_combined_grep", "messages summaries", """, a AS (SELECT 'message' AS kind, CAST(message_id AS VARCHAR) AS id, content FROM messages UNION ALL SELECT 'summary', summary_id, content FROM summaries WHERE suppressed_at IS NULL)
 SELECT kind, id, regexp_extract(content, '[a-z]+ing', 0) AS found FROM a WHERE regexp_matches(content, '[a-z]+ing')""")
def _(spark, d):
    return R.combined_grep(V.messages(spark, d), V.summaries(spark, d), "[a-z]+ing")


@query("a5_fit_budget", "", "WITH " + BM + """, t AS (SELECT bm.query_id, bm.doc_id, rank, CAST(ceil(0.25 * length(d.text)) AS BIGINT) AS token_count, CAST(ceil(length(b.text) / 4) AS BIGINT) AS asked FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = bm.query_id WHERE rank <= 10),
 r AS (SELECT *, asked + sum(token_count) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM t WHERE token_count <= 3000) SELECT query_id, doc_id, rank FROM r WHERE running <= 3000""")
def _(spark, d):
    sizes = V.summaries(spark, d).select("doc_id", "token_count")
    queries = V.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.ceil(F.length("text") / 4).alias("asked"))
    return R.fit_budget(_bm25(spark, d).join(sizes, "doc_id"), queries, 3000).select("query_id", "doc_id", "rank")


@query("a6_batch_packing", "summaries", _PACK.format(src="(SELECT conversation_id, doc_id AS ordinal, token_count FROM summaries)", b=2000) + "SELECT conversation_id, ordinal AS doc_id, chunk FROM p")
def _(spark, d):
    s = V.summaries(spark, d).select("conversation_id", "doc_id", "token_count")
    return W.greedy_pack(s, "conversation_id", "doc_id", "token_count", 2000).select("conversation_id", "doc_id", "chunk")


@query("a8_hidden_vectors", "summaries", " SELECT vec_id, s.suppressed_at IS NOT NULL AS hidden FROM embeddings JOIN summaries s ON s.doc_id = vec_id")
def _(spark, d):
    return V.read(spark, d, "embeddings").select("vec_id").join(V.summaries(spark, d).select(F.col("doc_id").alias("vec_id"), F.col("suppressed_at").isNotNull().alias("hidden")), "vec_id")


@query("p8_source_text", "items messages", _CHUNKS + """ SELECT p.conversation_id, p.chunk, sha256(string_agg('[' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY p.ordinal)) AS source_hash
 FROM p JOIN messages m ON m.conversation_id = p.conversation_id AND m.seq = p.ordinal GROUP BY 1, 2""")
def _(spark, d):
    lined = _chunks(spark, d).join(V.messages(spark, d).withColumnRenamed("seq", "ordinal"), ["conversation_id", "ordinal"])
    return R.chain_tokens(lined, ["conversation_id", "chunk"]).select("conversation_id", "chunk", F.sha2("source_text", 256).alias("source_hash"))


@query("p11_compaction_decision", "messages", " SELECT conversation_id, greatest(CAST(sum(token_count) AS BIGINT), CAST(count(*) * 100 AS BIGINT)) AS tokens, greatest(sum(token_count), count(*) * 100) > 600 AS due FROM messages GROUP BY 1")
def _(spark, d):
    return R.compaction_decision(V.messages(spark, d).groupBy("conversation_id").agg(F.sum("token_count").alias("stored"), (F.count("*") * 100).alias("observed")), 800)


@query("p12_ineffective", "messages", ", g AS (SELECT conversation_id, sum(token_count) AS before, max(token_count) * 4 AS after FROM messages GROUP BY 1) SELECT conversation_id, after >= before OR before - after < 0.1 * before AS ineffective FROM g")
def _(spark, d):
    return R.ineffective(V.messages(spark, d).groupBy("conversation_id").agg(F.sum("token_count").alias("before"), (F.max("token_count") * 4).alias("after"))).select("conversation_id", "ineffective")


@query("p15_session_prune", "tree", " SELECT summary_id FROM nodes WHERE depth >= 2")
def _(spark, d):
    return V.tree(spark, d)[0].where("depth >= 2").select("summary_id")


@query("d3_leaf_messages", "items", _CHUNKS + " SELECT conversation_id, chunk, ordinal, row_number() OVER (PARTITION BY conversation_id, chunk ORDER BY ordinal) AS rank FROM p QUALIFY rank <= 2")
def _(spark, d):
    return R.first_by(_chunks(spark, d), ["conversation_id", "chunk"], [F.asc("ordinal")], 2)


@query("u2_dry_run", "summaries", " SELECT session_key, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM summaries WHERE suppressed_at IS NULL AND created_at >= TIMESTAMP '2024-01-01 02:00:00' AND created_at < TIMESTAMP '2024-01-01 12:00:00' AND token_count >= 50 GROUP BY 1")
def _(spark, d):
    from recall_spark.operators import conversations as C

    chosen = C.time_filter(C.visible(V.summaries(spark, d)), "2024-01-01 02:00:00", "2024-01-01 12:00:00").where("token_count >= 50")
    return chosen.groupBy("session_key").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))


_PERIODS = ", c AS (SELECT session_key, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') AS period, summary_id, suppressed_at FROM summaries)"


@query("u4_stale_caches", "summaries", _PERIODS + " SELECT DISTINCT session_key, period FROM c WHERE suppressed_at IS NOT NULL")
def _(spark, d):
    return V.summaries(spark, d).where("suppressed_at is not null").select("session_key", F.date_format("created_at", "yyyy-MM-dd HH").alias("period")).distinct()


@query("y5_leaf_fingerprint", "summaries", _PERIODS + " SELECT session_key, period, count(*) AS n_leaves, substring(sha256(string_agg(summary_id || chr(0), '' ORDER BY summary_id)), 1, 24) AS fingerprint FROM c GROUP BY 1, 2")
def _(spark, d):
    return R.leaf_fingerprint(V.summaries(spark, d).withColumn("period", F.date_format("created_at", "yyyy-MM-dd HH")), ["session_key", "period"])


@query("u10_unreferenced", "items", _CHUNKS + " SELECT message_id FROM items WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.conversation_id = items.conversation_id AND p.ordinal = items.ordinal)")
def _(spark, d):
    return V.context_items(spark, d).join(_chunks(spark, d), ["conversation_id", "ordinal"], "left_anti").select("message_id")


@query("u11_retention", "", "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_type <> 'click' GROUP BY 1")
def _(spark, d):
    return V.read(spark, d, "events").where("ts < timestamp'2024-01-10' and event_type <> 'click'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("q3_missing_conversations", "messages convs", " SELECT conversation_id, count(*) AS n FROM messages WHERE conversation_id NOT IN (SELECT conversation_id FROM convs WHERE conversation_id % 11 <> 3) GROUP BY 1")
def _(spark, d):
    return R.missing_conversations(V.messages(spark, d), V.conversations(spark, d).where("conversation_id % 11 <> 3"))


@query("q4_lineage", "tree", " SELECT summary_id FROM nodes WHERE depth > 0 AND summary_id NOT IN (SELECT summary_id FROM edges WHERE NOT ends_with(summary_id, '7'))")
def _(spark, d):
    nodes, edges = V.tree(spark, d)
    return R.lineage_gaps(nodes, edges.where(~F.endswith("summary_id", F.lit("7")))).select("summary_id")


@query("q6_token_sums", "items messages", ", a AS (SELECT conversation_id, sum(token_count) AS x FROM items WHERE ordinal % 13 <> 5 GROUP BY 1), b AS (SELECT conversation_id, sum(token_count) AS y FROM messages GROUP BY 1) SELECT conversation_id, CAST(y - coalesce(x, 0) AS BIGINT) AS difference FROM b LEFT JOIN a USING (conversation_id) WHERE y <> coalesce(x, 0)")
def _(spark, d):
    a = V.context_items(spark, d).where("ordinal % 13 <> 5").groupBy("conversation_id").agg(F.sum("token_count").alias("x"))
    b = V.messages(spark, d).groupBy("conversation_id").agg(F.sum("token_count").alias("y"))
    return b.join(a, "conversation_id", "left").select("conversation_id", (F.col("y") - F.coalesce("x", F.lit(0))).alias("difference")).where("difference <> 0")


@query("q7_message_sequence", "messages", ", b AS (SELECT * FROM messages WHERE seq % 13 <> 5) SELECT conversation_id, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing FROM b GROUP BY 1 HAVING max(seq) - min(seq) + 1 <> count(DISTINCT seq)")
def _(spark, d):
    return I.check_contiguous(V.messages(spark, d).where("seq % 13 <> 5"), "seq").select("conversation_id", "missing")


@query("q8_repeated_refs", "items", ", b AS (SELECT * FROM items UNION ALL SELECT * FROM items WHERE message_id % 19 = 0) SELECT conversation_id, message_id, count(*) AS copies FROM b GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    items = V.context_items(spark, d)
    return R.repeated_refs(items.union(items.where("message_id % 19 = 0")), "message_id")


_DAMAGE = ", x AS (SELECT conversation_id, summary_id, CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS depth, CASE WHEN doc_id % 10 = 2 THEN doc_id END AS ordinal FROM summaries WHERE doc_id % 10 < 3)"


@query("q12_damage_counts", "summaries", _DAMAGE + " SELECT conversation_id, count(*) AS n FROM x GROUP BY 1")
def _(spark, d):
    return V.summaries(spark, d).where("doc_id % 10 < 3").groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("q13_repair_order", "summaries", _DAMAGE + " SELECT conversation_id, summary_id, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE WHEN depth > 0 THEN 2 WHEN ordinal IS NULL THEN 1 ELSE 0 END, depth, ordinal NULLS LAST, summary_id) AS position FROM x")
def _(spark, d):
    s = V.summaries(spark, d)
    k = F.col("doc_id") % 10
    return R.repair_order(s.where(k < 3).withColumn("depth", F.when(k == 1, 1).otherwise(0)).select("conversation_id", "summary_id", "depth"), s.where(k == 2).select("summary_id", F.col("doc_id").alias("ordinal")))


@query("e3_truncate_tokens", "", "SELECT doc_id, length(substring(text, 1, 800)) AS n, sha256(substring(text, 1, 800)) AS head FROM documents")
def _(spark, d):
    return V.read(spark, d, "documents").select("doc_id", T.truncate_to_tokens("text", 200).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("head"))


@query("e5_new_messages", "messages", " SELECT conversation_id, seq FROM messages WHERE seq >= CASE WHEN conversation_id % 3 = 0 THEN 2 ELSE 0 END")
def _(spark, d):
    m = V.messages(spark, d)
    return R.new_messages(m, m.where("conversation_id % 3 = 0").select("conversation_id", F.lit(2).alias("cursor")).distinct()).select("conversation_id", "seq")


@query("e13_file_kinds", "", "SELECT CASE WHEN regexp_matches(url, '\\.html?([?#].*)?$') THEN 'markup' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def _(spark, d):
    return V.read(spark, d, "pages").groupBy(R.file_kind(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("e14_payload_profile", "", "SELECT page_id, length(html) - length(replace(html, chr(10), '')) + 1 AS n_lines, length(html) AS n_chars, len(regexp_extract_all(html, '<[a-zA-Z]')) AS n_tags FROM pages")
def _(spark, d):
    return V.read(spark, d, "pages").select("page_id", *R.payload_profile("html"))


@query("t3_blank_turns", "messages", " SELECT message_id FROM messages WHERE NOT (role = 'assistant' AND trim(substring(content, 1, CAST(seq % 4 AS BIGINT) * 5)) = '')")
def _(spark, d):
    m = V.messages(spark, d).withColumn("content", F.expr("substring(content, 1, cast(seq % 4 as int) * 5)"))
    return m.where(~((F.col("role") == "assistant") & (F.trim("content") == ""))).select("message_id")


@query("n4_mentions", "summaries", _SEEN + " SELECT count(*) AS n, count(DISTINCT summary_id) AS n_leaves FROM m")
def _(spark, d):
    return _mentions(spark, d).agg(F.count("*").alias("n"), F.countDistinct("summary_id").alias("n_leaves"))


@query("y1_period_bounds", "", """SELECT event_id, date_trunc('day', ts) AS day_since, date_trunc('day', ts) + INTERVAL 1 DAY AS day_before, date_trunc('week', ts) AS week_since, date_trunc('week', ts) + INTERVAL 7 DAY AS week_before FROM events""")
def _(spark, d):
    e = V.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("now"))
    return I.period_bounds(e, "now", "UTC").drop("now")


#: Two runs of every benchmark passage: the best ten by BM25, and the newest ten of what matches. Every seventh query is in
#: the second run alone; every fifth has a judged quality, the share of its hits among ten, in both.
def _runs(spark, d):
    from recall_spark.plans.queries import asked_once, for_all, found_once, truth
    from recall_spark.sources.shared import kept

    same = asked_once(spark, d)
    found = found_once(spark, d, same)
    right = kept(truth(spark, d, found))
    newest = N.best(found.withColumn("score", F.col("doc_id").cast("double")), "doc_id", 10)
    runs = []
    for hits in (N.best(found, "doc_id", 10), newest):
        quality = hits.groupBy("query_id").agg((F.count("*") / 10).alias("quality"))
        runs.append(for_all(same, S.recall_at_k(hits, right, [1, 10]).join(quality, "query_id")).withColumn("quality", F.when(F.col("query_id") % 5 == 0, F.col("quality"))))
    return runs[0].where("query_id % 7 <> 0"), runs[1]


def _strata(df):
    return df.withColumn("stratum", F.when(F.col("query_id") % 4 > 0, F.concat(F.lit("st"), F.col("query_id") % 3)))


_RUNS = "WITH " + BM + """, hits AS (SELECT query_id, doc_id, rank AS ra, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC, doc_id) AS rb FROM bm), truth AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
 z AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1), g AS (SELECT query_id, least(count(*), 10) / 10 AS q, min(ra) FILTER (ra <= 10 AND t) AS ba, min(rb) FILTER (rb <= 10 AND t) AS bb, count(*) FILTER (ra <= 10 AND t) AS ha, count(*) FILTER (rb <= 10 AND t) AS hb
   FROM (SELECT hits.*, truth.doc_id IS NOT NULL AS t FROM hits LEFT JOIN truth USING (query_id, doc_id)) GROUP BY 1),
 v AS (SELECT query_id, CASE WHEN query_id % 5 = 0 THEN q END AS quality, round(coalesce(1 / ba, 0), 6) AS ra, round(coalesce(1 / bb, 0), 6) AS rb, round(ha / n, 6) AS recall_a, round(hb / n, 6) AS recall_b, CASE WHEN query_id % 4 > 0 THEN 'st' || (query_id % 3) END AS stratum FROM z JOIN g USING (query_id)),
 t AS (SELECT query_id, stratum, CASE WHEN query_id % 7 <> 0 THEN round(coalesce(quality - quality, rb - ra), 6) END AS delta FROM v)"""


@query("v2_stratum_means", "", _RUNS + """ SELECT coalesce(stratum, 'unknown') AS stratum, count(*) AS n, round(avg(recall_b), 6) AS recall_10, round(avg(rb), 6) AS rr FROM v GROUP BY 1 UNION ALL SELECT 'overall', count(*), round(avg(recall_b), 6), round(avg(rb), 6) FROM v""")
def _(spark, d):
    b = _strata(_runs(spark, d)[1]).withColumn("stratum", F.coalesce("stratum", F.lit("unknown")))
    return R.stratum_means(b, ["recall_10", "rr"])


@query("v5_drift", "", _RUNS + " SELECT query_id, delta, CASE WHEN delta IS NULL THEN 'not compared' WHEN abs(delta) <= 0.1 THEN 'same' WHEN delta > 0 THEN 'improved' ELSE 'regressed' END AS verdict FROM t")
def _(spark, d):
    return R.drift(*_runs(spark, d), 0.05)


@query("v6_stratum_drift", "", _RUNS + """ SELECT coalesce(stratum, 'unknown') AS stratum, count(delta) AS n_scored, count(*) FILTER (delta > 0.1) AS improved, count(*) FILTER (delta < -0.1) AS regressed, round(coalesce(sum(delta), 0), 6) AS cumulative, round(coalesce(sum(delta), 0), 6) < -0.1 AS fell FROM t GROUP BY 1""")
def _(spark, d):
    a, b = _runs(spark, d)
    return R.stratum_drift(R.drift(a, b, 0.05), _strata(b), 0.05)


@query("s4_write_embeddings", "", "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0")
def _(spark, d):
    e = V.read(spark, d, "embeddings").select("vec_id", "label")
    return R.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), ["vec_id"])


@query("s7_link_once", "tree", " SELECT summary_id, source_summary_id, CAST(ordinal AS BIGINT) AS ordinal FROM edges UNION ALL SELECT summary_id, summary_id || 'x', CAST(max(ordinal) + 1 AS BIGINT) FROM edges GROUP BY 1, 2")
def _(spark, d):
    edges = V.tree(spark, d)[1]
    new = edges.select("summary_id", "source_summary_id").union(edges.select("summary_id", F.concat("summary_id", F.lit("x")))).distinct()
    return R.link_once(edges, new.union(new), ["summary_id", "source_summary_id"])
