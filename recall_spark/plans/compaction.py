"""Registered queries on the summary graph that compaction builds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_spark.operators import compaction as K
from recall_spark.operators import context as C
from recall_spark.operators import graph as D
from recall_spark.operators import integrity as I
from recall_spark.operators import records as R
from recall_spark.operators import repair as Q
from recall_spark.plans.queries import _PACK, _RANKED, _RAW, query
from recall_spark.sources import views as V

# Small sizes, so that conversations of a few messages are compacted to depth 2.
POLICY = K.Policy(tail=0, chunk=260, condensed_chunk=200, leaf_fanout=2, condensed_fanout=2, condensed_target=64, text_target=64, budget=80)
ROUNDS = 6  # of the SQL; contexts have at most six leaves, so no conversation has more


def swept(spark, d):
    return K.sweep_leaves(K.message_items(V.messages(spark, d)), POLICY)


def built(spark, d):
    return K.compact(K.message_items(V.messages(spark, d)), POLICY)


_TEXT = f"CASE WHEN length(x) <= 256 THEN '{C.FALLBACK_WHOLE}' || chr(10) || x ELSE '{C.FALLBACK_CUT}' || chr(10) || substring(x, 1, 256) END"
_MADE = f"(SELECT *, {_TEXT} AS content FROM (SELECT *, regexp_replace(source, '^\\s+|\\s+$', '', 'g') AS x FROM {{src}}))"
_AT = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
T, B = POLICY.threshold, POLICY.chunk

_LEAVES = _RAW.replace("rn > 2", f"rn > {POLICY.tail}") + _PACK.replace("p.used + q.token_count > {b}", "(p.used + q.token_count > {b} OR p.used >= {b})").format(src="raw", b=B) + f""", mem AS MATERIALIZED (SELECT p.conversation_id, p.chunk, p.ordinal, m.token_count, m.message_id, m.content, m.created_at FROM p JOIN messages m ON m.conversation_id = p.conversation_id AND m.seq = p.ordinal),
 due AS (SELECT conversation_id, before FROM (SELECT conversation_id, sum(token_count) AS before FROM messages GROUP BY 1) JOIN (SELECT conversation_id, sum(token_count) AS raw FROM mem GROUP BY 1) USING (conversation_id) WHERE before > {T} OR raw >= {B}),
 l0 AS (SELECT conversation_id, chunk, before, min(ordinal) AS ordinal, count(*) AS n, sum(token_count) AS removed, min(created_at) AS earliest_at, max(created_at) AS latest_at,
   string_agg('[' || {_AT.format(c="created_at")} || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY ordinal) AS source FROM mem JOIN due USING (conversation_id) GROUP BY 1, 2, 3),
 l1 AS (SELECT *, ceil(0.25 * length(content)) AS token_count FROM {_MADE.format(src="l0")}), l2 AS (SELECT *, before + sum(token_count - removed) OVER (PARTITION BY conversation_id ORDER BY chunk) AS running FROM l1),
 l3 AS (SELECT *, (running <= {T} OR token_count >= removed) AS stops FROM l2), leaves AS MATERIALIZED (SELECT * FROM (SELECT *, coalesce(sum(CAST(stops AS INT)) OVER (PARTITION BY conversation_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM l3) WHERE earlier = 0),
 taken0 AS MATERIALIZED (SELECT mem.conversation_id, mem.ordinal, CAST(mem.message_id AS VARCHAR) AS source_ref, 'sum_' || mem.conversation_id || '_0_' || mem.chunk AS ref FROM mem JOIN leaves USING (conversation_id, chunk)),
 items0 AS MATERIALIZED (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal, ref) - 1 AS ordinal, item_type, ref, depth, token_count, earliest_at, latest_at, content, descendants, descendant_tokens, source_tokens FROM (
   SELECT conversation_id, seq AS ordinal, 'message' AS item_type, CAST(message_id AS VARCHAR) AS ref, CAST(NULL AS INT) AS depth, token_count, created_at AS earliest_at, created_at AS latest_at, content, 0 AS descendants, 0 AS descendant_tokens, token_count AS source_tokens
   FROM messages WHERE (conversation_id, seq) NOT IN (SELECT (conversation_id, ordinal) FROM taken0)
   UNION ALL SELECT conversation_id, ordinal, 'summary', 'sum_' || conversation_id || '_0_' || chunk, 0, token_count, earliest_at, latest_at, content, 0, 0, removed FROM leaves)),
 state0 AS MATERIALIZED (SELECT conversation_id, coalesce(running, before) AS running, CASE WHEN running IS NULL THEN before WHEN running <= {T} OR NOT stops THEN running ELSE running - token_count + removed END AS previous
   FROM (SELECT conversation_id, sum(token_count) AS before FROM messages GROUP BY 1) LEFT JOIN (SELECT conversation_id, running, stops, token_count, removed FROM leaves QUALIFY chunk = max(chunk) OVER (PARTITION BY conversation_id)) USING (conversation_id))"""


def _chunks(i: int) -> str:
    """Members of the oldest chunk of each depth of items<i>, with what makes them eligible."""
    cap = POLICY.condensed_chunk
    return f""", r{i} AS (SELECT *, row_number() OVER w AS rn, CASE WHEN item_type = lag(item_type) OVER w AND depth IS NOT DISTINCT FROM lag(depth) OVER w THEN 0 ELSE 1 END AS starts FROM items{i} WINDOW w AS (PARTITION BY conversation_id ORDER BY ordinal DESC)),
 i{i} AS (SELECT * FROM (SELECT *, sum(starts) OVER (PARTITION BY conversation_id ORDER BY ordinal DESC) AS island FROM r{i}) WHERE rn > {POLICY.tail} AND item_type = 'summary'),
 o{i} AS (SELECT *, sum(token_count) OVER w AS used, row_number() OVER w AS place FROM (SELECT * FROM i{i} QUALIFY island = max(island) OVER (PARTITION BY conversation_id, depth)) WINDOW w AS (PARTITION BY conversation_id, depth ORDER BY ordinal)),
 c{i} AS MATERIALIZED (SELECT *, count(*) OVER w AS n, sum(token_count) OVER w AS tokens, count(*) OVER w >= 2 AND sum(token_count) OVER w >= {POLICY.least_input} AS eligible FROM o{i} WHERE place = 1 OR (used <= {cap} AND used - token_count < {cap}) WINDOW w AS (PARTITION BY conversation_id, depth))"""


def _round(i: int) -> str:
    """items<i>, state<i> and made<i> from those of the round before."""
    h = i - 1
    return _chunks(h) + f""", b{i} AS MATERIALIZED (SELECT * FROM c{h} WHERE eligible AND conversation_id IN (SELECT conversation_id FROM state{h} WHERE previous > {T}) QUALIFY depth = min(depth) OVER (PARTITION BY conversation_id)),
 g{i} AS (SELECT conversation_id, min(ordinal) AS ordinal, max(depth) + 1 AS depth, min(earliest_at) AS earliest_at, max(latest_at) AS latest_at, sum(token_count) AS removed, count(*) AS n, sum(descendants + 1) AS descendants, sum(descendant_tokens + token_count) AS descendant_tokens, sum(source_tokens) AS source_tokens,
   string_agg('[' || {_AT.format(c="earliest_at")} || ' - ' || {_AT.format(c="latest_at")} || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY ordinal) AS source FROM b{i} GROUP BY 1),
 made{i} AS MATERIALIZED (SELECT *, 'sum_' || conversation_id || '_{i}_0' AS ref, ceil(0.25 * length(content)) AS token_count FROM {_MADE.format(src=f"g{i}")}),
 items{i} AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal, ref) - 1 AS ordinal) FROM (SELECT * FROM items{h} WHERE ref NOT IN (SELECT ref FROM b{i})
   UNION ALL SELECT conversation_id, ordinal, 'summary', ref, depth, token_count, earliest_at, latest_at, content, descendants, descendant_tokens, source_tokens FROM made{i})),
 state{i} AS MATERIALIZED (SELECT conversation_id, now AS running, CASE WHEN now < running AND now < previous THEN now ELSE 0 END AS previous FROM (SELECT s.*, s.running - removed + token_count AS now FROM state{h} s JOIN made{i} USING (conversation_id)))"""


_BUILT = _LEAVES + "".join(_round(i) for i in range(1, ROUNDS + 1))
_NODE = "ref, conversation_id, depth, CAST(token_count AS BIGINT) AS token_count, earliest_at, latest_at, sha256(content) AS text_hash, CAST(n AS BIGINT) AS n, CAST(descendants AS BIGINT) AS descendants, CAST(descendant_tokens AS BIGINT) AS descendant_tokens, CAST(source_tokens AS BIGINT) AS source_tokens"
_NODES = ", nodes AS (SELECT 'sum_' || conversation_id || '_0_' || chunk AS ref, conversation_id, 0 AS depth, token_count, earliest_at, latest_at, content, n, 0 AS descendants, 0 AS descendant_tokens, removed AS source_tokens FROM leaves" + "".join(
    f" UNION ALL SELECT ref, conversation_id, depth, token_count, earliest_at, latest_at, content, n, descendants, descendant_tokens, source_tokens FROM made{i}" for i in range(1, ROUNDS + 1)) + ")"
_LINKS = ", links AS (SELECT ref, source_ref, ordinal FROM taken0" + "".join(f" UNION ALL SELECT 'sum_' || conversation_id || '_{i}_0', ref, ordinal FROM b{i}" for i in range(1, ROUNDS + 1)) + "), edges AS (SELECT ref, source_ref, row_number() OVER (PARTITION BY ref ORDER BY ordinal) - 1 AS ordinal FROM links)"
VIEWS = "items messages"


@query("p2_leaf_chunk_of_islands", VIEWS, _RANKED + f""", mixed AS (SELECT *, ordinal % 5 = 3 AS made FROM r WHERE rn > {POLICY.tail}), island AS (SELECT *, sum(CASE WHEN made THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ordinal) AS run FROM mixed),
 first AS (SELECT * FROM island WHERE NOT made QUALIFY run = min(run) OVER (PARTITION BY conversation_id)), u AS (SELECT *, sum(token_count) OVER w AS used, row_number() OVER w AS place FROM first WINDOW w AS (PARTITION BY conversation_id ORDER BY ordinal))
 SELECT conversation_id, ordinal FROM u WHERE place = 1 OR (used <= {B} AND used - token_count < {B})""")
def _(spark, d):
    kind = F.when(F.col("ordinal") % 5 == 3, "summary").otherwise("message")
    items = K.message_items(V.messages(spark, d)).withColumn("item_type", kind)
    return K.leaf_chunks(items, POLICY.tail, POLICY.chunk).where("chunk = 0").select("conversation_id", "ordinal")


@query("p4_condensed_chunks", VIEWS, _LEAVES + _chunks(0) + " SELECT conversation_id, depth, ref, n, CAST(tokens AS BIGINT) AS tokens, eligible FROM c0")
def _(spark, d):
    return K.condensed_chunks(swept(spark, d)[0], POLICY).select("conversation_id", "depth", "ref", "n", "tokens", "eligible")


@query("p5_condensation_candidates", VIEWS, _LEAVES + _chunks(0) + " SELECT conversation_id, depth, ref, n, CAST(tokens AS BIGINT) AS tokens FROM c0 WHERE eligible QUALIFY depth = min(depth) OVER (PARTITION BY conversation_id)")
def _(spark, d):
    return K.condensation_candidates(swept(spark, d)[0], POLICY).select("conversation_id", "depth", "ref", "n", "tokens")


@query("p10_compact_summaries", VIEWS, _BUILT + _NODES + f" SELECT {_NODE} FROM nodes")
def _(spark, d):
    return built(spark, d)[1].select("ref", "conversation_id", "depth", "token_count", "earliest_at", "latest_at", F.sha2("content", 256).alias("text_hash"), "n", "descendants", "descendant_tokens", "source_tokens")


@query("p10_compact_context", VIEWS, _BUILT + f" SELECT conversation_id, CAST(ordinal AS BIGINT) AS ordinal, item_type, ref, depth, CAST(token_count AS BIGINT) AS token_count FROM items{ROUNDS}")
def _(spark, d):
    return built(spark, d)[0].select("conversation_id", "ordinal", "item_type", "ref", "depth", "token_count")


@query("p10_compact_edges", VIEWS, _BUILT + _LINKS + " SELECT * FROM edges")
def _(spark, d):
    return built(spark, d)[2]


def _edges(edges):
    return edges.select(F.col("ref").alias("summary_id"), F.col("source_ref").alias("source_summary_id"), "ordinal")


_WALK = ", RECURSIVE walk AS (SELECT ref AS root, ref AS summary_id, 0 AS depth, '' AS path FROM nodes WHERE depth > 0 UNION ALL SELECT w.root, e.source_ref, w.depth + 1, CASE WHEN path = '' THEN '' ELSE path || '.' END || lpad(CAST(e.ordinal AS VARCHAR), 4, '0') FROM walk w JOIN edges e ON e.ref = w.summary_id)"


@query("d1_expand_built", VIEWS, _BUILT + _NODES + _LINKS + _WALK + " SELECT root, summary_id, depth, path FROM walk")
def _(spark, d):
    _, nodes, edges = built(spark, d)
    return D.expand_paths(_edges(edges), nodes.where("depth > 0").select(F.col("ref").alias("root")))


@query("d4_manifest_built", VIEWS, _BUILT + _NODES + _LINKS + _WALK + """, seen AS (SELECT w.*, n.conversation_id, n.token_count + n.descendant_tokens AS one, n.source_tokens AS raw, n.latest_at FROM walk w JOIN nodes n ON n.ref = w.summary_id WHERE NOT (n.depth = 0 AND ends_with(n.ref, '_2'))),
 placed AS (SELECT *, count(*) OVER (PARTITION BY root) AS n_nodes, row_number() OVER (PARTITION BY root ORDER BY depth, path, latest_at, summary_id) AS place, CASE WHEN conversation_id % 2 = 0 THEN 300 ELSE 700 END AS budget FROM seen)
 SELECT root, p.summary_id, CASE WHEN p.depth > 0 THEN e.ref END AS before, depth, path, (SELECT count(*) FROM edges x WHERE x.ref = p.summary_id AND starts_with(x.source_ref, 'sum_')) AS n_below, CAST(one AS BIGINT) AS summaries_only, CAST(one + raw AS BIGINT) AS with_messages, one <= budget AS fits_summaries_only, one + raw <= budget AS fits_with_messages, n_nodes
 FROM placed p LEFT JOIN edges e ON e.source_ref = p.summary_id WHERE place <= 4""")
def _(spark, d):
    _, nodes, edges = built(spark, d)
    s = nodes.select(F.col("ref").alias("summary_id"), "token_count", "descendant_tokens", "source_tokens", F.col("latest_at").alias("created_at"), ((F.col("depth") == 0) & F.endswith("ref", F.lit("_2"))).alias("suppressed"))
    roots = nodes.where("depth > 0").select(F.col("ref").alias("root"), F.when(F.col("conversation_id") % 2 == 0, 300).alias("budget"))
    return D.manifest(s, _edges(edges).where("source_summary_id like 'sum%'"), roots, 700, 4)


@query("d6_depths_built", VIEWS, _BUILT + _NODES + " SELECT ref AS summary_id, depth FROM nodes")
def _(spark, d):
    _, nodes, edges = built(spark, d)
    inner = _edges(edges).join(nodes.select(F.col("ref").alias("source_summary_id")), "source_summary_id", "left_semi")
    return D.compute_depths(nodes.select(F.col("ref").alias("summary_id")), inner)


@query("q4_lineage_built", VIEWS, _BUILT + _NODES + _LINKS + " SELECT ref AS summary_id FROM nodes WHERE ref NOT IN (SELECT ref FROM edges WHERE NOT ends_with(source_ref, '2'))")
def _(spark, d):
    _, nodes, edges = built(spark, d)
    return R.lineage_gaps(nodes.withColumnRenamed("ref", "summary_id"), _edges(edges).where(~F.endswith("source_summary_id", F.lit("2"))), 0).select("summary_id")


@query("q5_orphans_built", VIEWS, _BUILT + _NODES + _LINKS + f" SELECT ref AS summary_id FROM nodes WHERE ref NOT IN (SELECT source_ref FROM edges) AND ref NOT IN (SELECT ref FROM items{ROUNDS} WHERE ordinal % 2 = 0)")
def _(spark, d):
    items, nodes, edges = built(spark, d)
    return R.orphans(nodes.withColumnRenamed("ref", "summary_id"), _edges(edges), items.where("ordinal % 2 = 0").withColumnRenamed("ref", "summary_id")).select("summary_id")


@query("u1_suppress_everywhere", VIEWS, _BUILT + _NODES + _LINKS + f""", links2 AS (SELECT ref, source_ref FROM edges WHERE starts_with(ref, 'sum_') AND NOT starts_with(source_ref, 'sum_') UNION ALL SELECT 'extra_' || ref, source_ref FROM edges WHERE NOT starts_with(source_ref, 'sum_') AND CAST(source_ref AS BIGINT) % 3 = 0),
 chosen AS (SELECT ref FROM nodes WHERE depth = 0 AND ends_with(ref, '_1')), cov AS (SELECT DISTINCT source_ref FROM links2 WHERE ref IN (SELECT ref FROM chosen))
 SELECT 'hidden' AS step, ref AS id FROM chosen UNION ALL SELECT DISTINCT 'flagged', ref FROM edges WHERE source_ref IN (SELECT ref FROM chosen) UNION ALL SELECT 'messages', source_ref FROM cov WHERE source_ref NOT IN (SELECT source_ref FROM links2 WHERE ref NOT IN (SELECT ref FROM chosen))
 UNION ALL SELECT 'items', conversation_id || ':' || ordinal FROM items0 WHERE ref IN (SELECT ref FROM chosen) OR ref IN (SELECT source_ref FROM cov) UNION ALL SELECT DISTINCT 'caches', 'day of ' || conversation_id FROM nodes WHERE ref IN (SELECT ref FROM chosen)""")
def _(spark, d):
    items, _, _ = swept(spark, d)
    _, nodes, edges = built(spark, d)
    leaf = edges.where("source_ref not like 'sum%'").select(F.col("ref").alias("summary_id"), F.col("source_ref").cast("long").alias("message_id"))
    links = leaf.union(leaf.where("message_id % 3 = 0").select(F.concat(F.lit("extra_"), "summary_id"), "message_id"))
    s = nodes.select(F.col("ref").alias("summary_id"), F.lit(False).alias("suppressed"))
    every = s.union(links.where("summary_id like 'extra%'").select("summary_id", F.lit(False)).distinct())
    caches = nodes.where("depth = 0").select(F.concat(F.lit("day of "), "conversation_id").alias("cache_id"), F.col("ref").alias("summary_id"))
    chosen = nodes.where("depth = 0").where(F.endswith("ref", F.lit("_1"))).select(F.col("ref").alias("summary_id"))
    out = I.suppress_everywhere(every, _edges(edges), links, items.select("conversation_id", "ordinal", "item_type", "ref"), caches, chosen)
    ids = {"hidden": F.col("summary_id"), "flagged": F.col("summary_id"), "messages": F.col("message_id").cast("string"), "items": F.concat_ws(":", "conversation_id", "ordinal"), "caches": F.col("cache_id")}
    parts = [df.select(F.lit(step).alias("step"), ids[step].alias("id")) for step, df in out.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


# --- repair -----------------------------------------------------------------------------------------------------------

STEPS = 12  # of the SQL; no conversation has more damaged summaries
_MARK = I.TRUNCATED_PREFIX + "999 tokens]"
_HURT = "(conversation_id % 3 = 0 OR ends_with(ref, '_1'))"


def graph(spark, d):
    """The built graph as the tables of repair; in every third conversation all summaries are damaged, elsewhere each second leaf."""
    items, nodes, edges = (K.kept(x) for x in built(spark, d))
    hurt = (F.col("conversation_id") % 3 == 0) | F.endswith("ref", F.lit("_1"))
    text = F.when(hurt, F.concat(F.substring("content", 1, 40), F.lit(_MARK))).otherwise(F.col("content"))
    s = nodes.select("conversation_id", F.col("ref").alias("summary_id"), "depth", text.alias("content"), "earliest_at", "latest_at", F.col("latest_at").alias("created_at"), "token_count")
    inner = F.startswith("source_ref", F.lit("sum_"))
    links = edges.where(~inner).select(F.col("ref").alias("summary_id"), F.col("source_ref").cast("long").alias("message_id"), "ordinal")
    return s, _edges(edges.where(inner)), links, V.messages(spark, d), items.where("item_type = 'summary'").select("conversation_id", F.col("ref").alias("summary_id"), "ordinal")


_GRAPH = _BUILT + _NODES + _LINKS + f""", s AS MATERIALIZED (SELECT conversation_id, ref AS summary_id, depth, CASE WHEN {_HURT} THEN substring(content, 1, 40) || '{_MARK}' ELSE content END AS content, earliest_at, latest_at FROM nodes),
 inner_edges AS (SELECT * FROM edges WHERE starts_with(source_ref, 'sum_')),
 by_context AS (SELECT summary_id, lag(summary_id) OVER (PARTITION BY s.conversation_id, s.depth ORDER BY i.ordinal) AS p FROM s JOIN items{ROUNDS} i ON i.ref = s.summary_id),
 by_siblings AS (SELECT source_ref AS summary_id, lag(source_ref) OVER (PARTITION BY ref ORDER BY ordinal) AS p FROM inner_edges),
 by_time AS (SELECT summary_id, lag(summary_id) OVER (PARTITION BY conversation_id, depth ORDER BY latest_at, summary_id) AS p FROM s),
 prev AS MATERIALIZED (SELECT s.summary_id, coalesce(a.p, b.p, c.p) AS previous, CASE WHEN a.p IS NOT NULL THEN 'context' WHEN b.p IS NOT NULL THEN 'siblings' WHEN c.p IS NOT NULL THEN 'time' END AS via
   FROM s LEFT JOIN by_context a USING (summary_id) LEFT JOIN by_siblings b USING (summary_id) LEFT JOIN by_time c USING (summary_id))"""


def _step(i: int) -> str:
    """Texts after the i-th damaged summary of every conversation is rebuilt."""
    h = i - 1
    mark = f"strpos(new, '{I.TRUNCATED_PREFIX}')"
    return f""", made_of{i} AS (SELECT t.summary_id, string_agg('[' || {_AT.format(c="x.earliest_at")} || ' - ' || {_AT.format(c="x.latest_at")} || ']' || chr(10) || x.content, chr(10) || chr(10) ORDER BY e.ordinal) AS source
   FROM todo t JOIN inner_edges e ON e.ref = t.summary_id JOIN cur{h} x ON x.summary_id = e.source_ref WHERE t.position = {i} GROUP BY 1),
 new{i} AS (SELECT t.summary_id, t.depth || '|' || coalesce(substring(p.content, 1, 30), '-') || '|' || substring(coalesce(l.source, m.source), 1, 200) AS new FROM todo t JOIN prev USING (summary_id) LEFT JOIN cur{h} p ON p.summary_id = prev.previous
   LEFT JOIN leaf_source l ON l.summary_id = t.summary_id AND t.depth = 0 LEFT JOIN made_of{i} m ON m.summary_id = t.summary_id WHERE t.position = {i}),
 did{i} AS MATERIALIZED (SELECT summary_id, trim(new, ' ' || chr(10) || chr(9)) AS new, ({mark} > 0 AND length(new) - {mark} + 1 < {I.TRUNCATED_WINDOW}) AS skipped FROM new{i}),
 cur{i} AS MATERIALIZED (SELECT c.* REPLACE (CASE WHEN skipped IS FALSE THEN new ELSE content END AS content) FROM cur{h} c LEFT JOIN did{i} d USING (summary_id))"""


_REPAIRED = _GRAPH + f""", todo AS MATERIALIZED (SELECT summary_id, s.depth, row_number() OVER (PARTITION BY s.conversation_id ORDER BY CASE WHEN s.depth > 0 THEN 2 WHEN i.ref IS NULL THEN 1 ELSE 0 END, CASE WHEN s.depth = 0 THEN i.ordinal END, s.depth, s.latest_at, summary_id) AS position
   FROM s LEFT JOIN items{ROUNDS} i ON i.ref = s.summary_id WHERE strpos(s.content, '{I.TRUNCATED_PREFIX}') > 0),
 leaf_source AS MATERIALIZED (SELECT e.ref AS summary_id, string_agg('[' || {_AT.format(c="created_at")} || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY e.ordinal) AS source FROM edges e JOIN messages m ON CAST(m.message_id AS VARCHAR) = e.source_ref GROUP BY 1),
 cur0 AS (SELECT summary_id, content, earliest_at, latest_at FROM s)""" + "".join(_step(i) for i in range(1, STEPS + 1)) + ", did AS (" + " UNION ALL ".join(f"SELECT * FROM did{i}" for i in range(1, STEPS + 1)) + ")"


@query("j7_previous_of_three_orders", VIEWS, _GRAPH + " SELECT summary_id, previous, via FROM prev")
def _(spark, d):
    s, edges, _, _, context = graph(spark, d)
    return Q.previous_summaries(s, edges, context)


@query("q14_repair_texts", VIEWS, _REPAIRED + """ SELECT summary_id, depth, CASE WHEN skipped THEN 'skipped' ELSE 'repaired' END AS status, CASE WHEN skipped THEN 'rewritten content still contains a doctor marker' END AS reason,
 CASE WHEN NOT skipped THEN sha256(new) END AS text_hash, CASE WHEN NOT skipped THEN CAST(ceil(0.25 * length(new)) AS BIGINT) END AS token_count FROM did JOIN todo USING (summary_id)""")
def _(spark, d):
    rewrite = lambda source, told, depth: F.concat_ws("|", depth.cast("string"), F.coalesce(F.substring(told, 1, 30), F.lit("-")), F.substring(source, 1, 200))
    return Q.repair_texts(*graph(spark, d), rewrite).select("summary_id", "depth", "status", "reason", F.sha2("content", 256).alias("text_hash"), "token_count")


@query("q9_repair_plan", VIEWS + " convs", _BUILT + _NODES + _LINKS + f""", cut AS (SELECT conversation_id, CAST(ordinal AS BIGINT) AS ordinal, item_type, CASE WHEN ordinal % 5 = 2 THEN 'none' ELSE ref END AS ref FROM items{ROUNDS} WHERE conversation_id % 6 <> 1 OR ordinal % 3 <> 1),
 ctx AS MATERIALIZED (SELECT * FROM cut UNION ALL SELECT conversation_id, ordinal + 1000, item_type, ref FROM cut WHERE conversation_id % 4 = 1 AND ordinal % 2 = 1), msg AS (SELECT * FROM messages WHERE conversation_id % 5 <> 2 OR seq % 3 <> 1),
 lineage AS (SELECT ref, source_ref FROM edges WHERE NOT ends_with(ref, '_1') AND (NOT starts_with(source_ref, 'sum_') OR NOT ends_with(ref, '_2_0'))), every AS (SELECT conversation_id FROM ctx UNION SELECT conversation_id FROM msg UNION SELECT conversation_id FROM nodes),
 dup AS (SELECT conversation_id, item_type, ref, min(ordinal) AS o, string_agg(CAST(ordinal AS VARCHAR), ', ' ORDER BY ordinal) AS l FROM ctx GROUP BY ALL HAVING count(*) > 1)
 SELECT conversation_id, 'conversation_exists' AS "check", 'Create or restore conversation ' || conversation_id || ' in the conversations table' AS suggestion FROM every WHERE conversation_id NOT IN (SELECT conversation_id FROM convs WHERE conversation_id % 11 <> 3)
 UNION ALL SELECT conversation_id, 'context_items_contiguous', 'Resequence context items to fix ordinal gaps' FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) - 1 AS place FROM ctx) WHERE place <> ordinal GROUP BY 1
 UNION ALL SELECT conversation_id, 'context_items_valid_refs', 'Remove context item at ordinal ' || ordinal || ' referencing missing ' || item_type || ' ' || ref FROM ctx WHERE CASE item_type WHEN 'message' THEN ref NOT IN (SELECT CAST(message_id AS VARCHAR) FROM msg) ELSE ref NOT IN (SELECT ref FROM nodes) END
 UNION ALL SELECT conversation_id, 'summaries_have_lineage', 'Add missing lineage for ' || CASE WHEN depth = 0 THEN 'leaf summary ' || ref || ' (link to source messages via summary_messages)' ELSE 'condensed summary ' || ref || ' (link to parent summaries via summary_parents)' END FROM nodes WHERE ref NOT IN (SELECT ref FROM lineage)
 UNION ALL SELECT conversation_id, 'no_orphan_summaries', 'Remove orphaned summary ' || ref || ' from summaries table' FROM nodes WHERE ref NOT IN (SELECT source_ref FROM lineage) AND ref NOT IN (SELECT ref FROM ctx)
 UNION ALL SELECT conversation_id, 'message_seq_contiguous', 'Resequence message seq values to eliminate gaps (renumber starting from 0)' FROM (SELECT conversation_id, seq, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) - 1 AS place FROM msg) WHERE place <> seq GROUP BY 1
 UNION ALL SELECT conversation_id, 'no_duplicate_context_refs', 'Deduplicate ' || item_type || ' ' || ref || ': keep ordinal ' || o || ', remove ordinals ' || substring(l, length(CAST(o AS VARCHAR)) + 3) FROM dup""")
def _(spark, d):
    items, nodes, edges = (K.kept(x) for x in built(spark, d))
    i0 = items.where("conversation_id % 6 <> 1 or ordinal % 3 <> 1").select("conversation_id", "ordinal", "item_type", F.when(F.col("ordinal") % 5 == 2, "none").otherwise(F.col("ref")).alias("ref"))
    context = i0.union(i0.where("conversation_id % 4 = 1 and ordinal % 2 = 1").withColumn("ordinal", F.col("ordinal") + 1000))
    inner = F.startswith("source_ref", F.lit("sum_"))
    lineage = edges.where(~F.endswith("ref", F.lit("_1")) & (~inner | ~F.endswith("ref", F.lit("_2_0"))))
    s = nodes.select("conversation_id", F.col("ref").alias("summary_id"), "depth")
    known = V.conversations(spark, d).where("conversation_id % 11 <> 3")
    return Q.repair_plan(known, V.messages(spark, d).where("conversation_id % 5 <> 2 or seq % 3 <> 1"), s, _edges(lineage.where(inner)), lineage.where(~inner).select(F.col("ref").alias("summary_id")), context)
