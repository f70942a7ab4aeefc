"""Resolution, worklists, status, entities, repairs and evaluation over the store's tables, for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Body cap of a hit, attempts of an extraction, least saving of a pass, length of a leaf fingerprint.
BODY_CAP, ATTEMPTS, LEAST_SAVING, FINGERPRINT = 5000, 5, 0.1, 24
# File kinds by extension.
FILE_KINDS = {"html": "markup", "htm": "markup", "xml": "markup", "csv": "table", "tsv": "table", "json": "json", "py": "code", "js": "code", "md": "text", "txt": "text"}


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered; partial ranks keep n rows a task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


def resolve_scope(requests: DataFrame) -> DataFrame:
    """requests (request_id, conversation_id, everything, session_key, session_id) with the scope that wins: id, all, key family, session."""
    kind = F.when(F.col("conversation_id").isNotNull(), "id").when(F.col("everything"), "all").when(F.trim("session_key") != "", "family").when(F.col("session_id").isNotNull(), "session").otherwise("none")
    value = F.when(kind == "id", F.col("conversation_id").cast("string")).when(kind == "family", F.trim("session_key")).when(kind == "session", F.col("session_id"))
    return requests.select("request_id", kind.alias("scope"), value.alias("value"))


def match_names(entities: DataFrame, name: str, asked: str) -> DataFrame:
    """entities whose name is, starts with or contains what is asked, in any case; wildcards are plain characters."""
    low, asked = F.lower(name), asked.lower()
    how = F.when(low == asked, "exact").when(F.startswith(low, F.lit(asked)), "prefix").when(F.contains(low, F.lit(asked)), "substring")
    return entities.withColumn("how", how).where("how is not null")


def resolve_items(items: DataFrame, m: DataFrame, s: DataFrame) -> DataFrame:
    """Context items (conversation_id, ordinal, message_id, summary_id) with their row's tokens and content; items without a row go."""
    a = items.where("message_id is not null").join(m.select("message_id", "content", "token_count"), "message_id").select("conversation_id", "ordinal", F.lit("message").alias("item_type"), "token_count", "content")
    b = items.where("message_id is null").join(s.select("summary_id", "content", "token_count"), "summary_id").select("conversation_id", "ordinal", F.lit("summary").alias("item_type"), "token_count", "content")
    return a.union(b)


def covering_leaves(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(conversation_id, chunk, first_hit): leaves that cover hit messages, by their first hit."""
    return hits.join(links, ["conversation_id", "ordinal"]).groupBy("conversation_id", "chunk").agg(F.min("ordinal").alias("first_hit"))


def collectable(m: DataFrame, covered: DataFrame, context: DataFrame, role: str) -> DataFrame:
    """Messages of a role that a summary covers and that no context holds."""
    key = ["conversation_id", "ordinal"]
    return m.where(F.col("role") == role).join(covered.select(*key), key, "left_semi").join(context.select(*key), key, "left_anti")


def pending_extractions(s: DataFrame, jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest visible leaves of each session that are not done and were not tried ATTEMPTS times."""
    open_ = s.where("suppressed_at is null and kind = 'leaf'").join(jobs, "summary_id", "left").where(f"not coalesce(done, false) and coalesce(attempts, 0) < {ATTEMPTS}")
    return first_by(open_, ["session_key"], [F.asc("created_at"), F.asc("summary_id")], n)


def previous(df: DataFrame, keys: list[str], order: list[str], column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(Window.partitionBy(*keys).orderBy(*order))


def pair_calls(events: DataFrame, key: list[str]) -> DataFrame:
    """First call of each call id, and the first result after it; calls without one have none."""
    calls = events.where("kind = 'call'").groupBy(*key).agg(F.min("at").alias("called_at"))
    results = events.where("kind = 'result'").select(*key, F.col("at").alias("result_at"))
    return calls.join(results, key, "left").groupBy(*key, "called_at").agg(F.min(F.when(F.col("result_at") > F.col("called_at"), F.col("result_at"))).alias("answered_at"))


def conversation_metrics(m: DataFrame, s: DataFrame) -> DataFrame:
    """Messages, their tokens, summaries, theirs, and hidden ones, of each conversation that has any."""
    a = m.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), F.sum("token_count").alias("context_tokens"))
    b = s.groupBy("conversation_id").agg(F.count("*").alias("n_summaries"), F.sum("token_count").alias("compressed_tokens"), F.count_if(F.col("suppressed_at").isNotNull()).alias("n_hidden"))
    zero = ["n_messages", "context_tokens", "n_summaries", "compressed_tokens", "n_hidden"]
    return a.join(b, "conversation_id", "full").na.fill(0, zero)


def entity_summary(mentions: DataFrame) -> DataFrame:
    """Visible mentions (session_key, summary_id, type, surface, created_at) by folded surface."""
    return mentions.groupBy(F.lower("surface").alias("entity")).agg(F.count("*").alias("occurrences"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.countDistinct("session_key").alias("n_sessions"), F.min("type").alias("type"))


def alternate_surfaces(mentions: DataFrame) -> DataFrame:
    """Entities that are written in more than one case, with their surfaces; the least is the canonical one."""
    own = mentions.select(F.lower("surface").alias("entity"), "surface").distinct()
    return own.groupBy("entity").agg(F.min("surface").alias("canonical"), F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"), F.count("*").alias("n")).where("n > 1").select("entity", "canonical", "surfaces")


def catalogue_coverage(sessions: DataFrame, mentions: DataFrame) -> DataFrame:
    """Whether a session has entities, others have, or none has."""
    some = mentions.select(F.lit(True).alias("some")).limit(1)
    own = mentions.select("session_key").distinct().withColumn("own", F.lit(True))
    state = F.when(F.col("own"), "active").when(F.col("some"), "empty_for_session").otherwise("empty_globally")
    return sessions.join(own, "session_key", "left").join(F.broadcast(some), F.lit(True), "left").select("session_key", state.alias("state"))  # one row


def embedding_health(s: DataFrame, embedded: DataFrame, low: int, high: int) -> DataFrame:
    lined = s.join(embedded.select("summary_id").distinct().withColumn("has", F.lit(True)), "summary_id", "left")
    seen, has = F.col("suppressed_at").isNull(), F.coalesce("has", F.lit(False))
    fits = F.col("token_count").between(low, high)
    return lined.agg(F.count_if(seen & has).alias("embedded"), F.count_if(seen & ~has & fits).alias("pending"), F.count_if(seen & (F.col("token_count") > high)).alias("over_cap"), F.count_if(~seen).alias("suppressed"))


def register_version(versions: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """versions (keys, version, active) with a new active one for each row of new (keys); earlier ones of these keys are inactive."""
    last = versions.groupBy(*keys).agg(F.max("version").alias("last"))
    added = new.select(*keys).distinct().join(last, keys, "left").select(*keys, (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version"), F.lit(True).alias("active"))
    touched = new.select(*keys).distinct().withColumn("touched", F.lit(True))
    kept = versions.join(touched, keys, "left").select(*keys, "version", (F.col("active") & F.col("touched").isNull()).alias("active"))
    return kept.union(added)


def cap_body(hits: DataFrame, text: str, cap: int = BODY_CAP) -> DataFrame:
    return hits.withColumns({"truncated": F.length(text) > cap, text: F.substring(text, 1, cap)})


def page(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The n rows behind a key, in its order."""
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def merge_hits(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two ranked lists (query_id, key, rank) as one, with where a hit came from."""
    both = a.select("query_id", key, F.col("rank").alias("text_rank")).join(b.select("query_id", key, F.col("rank").alias("vector_rank")), ["query_id", key], "full")
    return both.withColumn("source", F.when(F.col("vector_rank").isNull(), "text").when(F.col("text_rank").isNull(), "vector").otherwise("both"))


def verbatim(m: DataFrame, phrase: str, role: str, n: int) -> DataFrame:
    """Full rows of messages that contain a phrase as it stands, newest first, at most n of a conversation."""
    hit = m.where(F.contains("content", F.lit(phrase)))
    return first_by(hit if role == "all" else hit.where(F.col("role") == role), ["conversation_id"], [F.desc("seq")], n)


def combined_grep(m: DataFrame, s: DataFrame, pattern: str) -> DataFrame:
    """Messages and visible summaries that a pattern finds, labelled."""
    a = m.where(F.col("content").rlike(pattern)).select(F.lit("message").alias("kind"), F.col("message_id").cast("string").alias("id"), F.regexp_extract("content", pattern, 0).alias("found"))
    b = s.where("suppressed_at is null").where(F.col("content").rlike(pattern)).select(F.lit("summary").alias("kind"), F.col("summary_id").alias("id"), F.regexp_extract("content", pattern, 0).alias("found"))
    return a.union(b)


def compaction_decision(status: DataFrame, window: int, share: float = 0.75) -> DataFrame:
    """status (conversation_id, stored, observed): whether the larger of both is beyond the share of the window."""
    tokens = F.greatest(F.coalesce("stored", F.lit(0)), F.coalesce("observed", F.lit(0)))
    return status.select("conversation_id", tokens.alias("tokens"), (tokens > share * window).alias("due"))


def ineffective(passes: DataFrame) -> DataFrame:
    """passes (before, after): whether a pass saved less than LEAST_SAVING, or nothing."""
    return passes.withColumn("ineffective", (F.col("after") >= F.col("before")) | (F.col("before") - F.col("after") < LEAST_SAVING * F.col("before")))


def fit_budget(ranked: DataFrame, queries: DataFrame, budget: int) -> DataFrame:
    """Candidates of each query (query_id, rank, token_count) in order, until one doesn't fit beside those before and the query (query_id, asked) itself.

    Candidates beyond the budget on their own are passed over, wherever they stand. A null count is 0.
    """
    small = ranked.withColumn("token_count", F.coalesce("token_count", F.lit(0))).where(F.col("token_count") <= budget).join(queries, "query_id")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return small.withColumn("running", F.sum("token_count").over(w) + F.col("asked")).where(F.col("running") <= budget).drop("running", "asked")


def chain_tokens(parts: DataFrame, key: list[str]) -> DataFrame:
    """Source text of each key: `[time]` and text of its messages, in order. Keys are leaf chunks, which a token budget bounds."""
    block = F.concat(F.lit("["), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("]\n"), F.col("content"))
    return parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", block.alias("t")))).alias("x")).select(*key, F.array_join(F.transform("x", lambda r: r["t"]), "\n\n").alias("source_text"))


def lineage_gaps(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """Condensed nodes without sources."""
    return nodes.where(F.col("depth") >= least).join(edges.select("summary_id").distinct(), "summary_id", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame, context: DataFrame) -> DataFrame:
    """Nodes that are in no context and the source of nothing."""
    return nodes.join(edges.select(F.col("source_summary_id").alias("summary_id")).distinct(), "summary_id", "left_anti").join(context.select("summary_id").distinct(), "summary_id", "left_anti")


def repeated_refs(items: DataFrame, ref: str) -> DataFrame:
    return items.groupBy("conversation_id", ref).agg(F.count("*").alias("copies")).where("copies > 1")


def missing_conversations(m: DataFrame, convs: DataFrame) -> DataFrame:
    return m.join(convs.select("conversation_id"), "conversation_id", "left_anti").groupBy("conversation_id").agg(F.count("*").alias("n"))


def repair_order(damaged: DataFrame, context: DataFrame) -> DataFrame:
    """Damaged nodes (conversation_id, summary_id, depth): leaves in context by ordinal, other leaves, condensed ones from the lowest depth on."""
    lined = damaged.join(context.select("summary_id", "ordinal"), "summary_id", "left")
    group = F.when(F.col("depth") > 0, 2).when(F.col("ordinal").isNull(), 1).otherwise(0)
    w = Window.partitionBy("conversation_id").orderBy(group, "depth", F.asc_nulls_last("ordinal"), "summary_id")
    return lined.withColumn("position", F.row_number().over(w).cast("long")).select("conversation_id", "summary_id", "position")


def new_messages(incoming: DataFrame, cursor: DataFrame) -> DataFrame:
    """Incoming messages from the cursor on."""
    return incoming.join(cursor, "conversation_id", "left").where(F.col("seq") >= F.coalesce("cursor", F.lit(0)))


def file_kind(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    kind = F.lit("other")
    for e, k in FILE_KINDS.items():
        kind = F.when(extension == e, k).otherwise(kind)
    return kind


def payload_profile(text: str) -> list[Column]:
    """Lines, characters and tags of a payload."""
    return [(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.length(text).cast("long").alias("n_chars"), F.regexp_count(text, F.lit("<[a-zA-Z]")).cast("long").alias("n_tags")]


def leaf_fingerprint(s: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 over the sorted ids of each key's leaves, each with a zero byte, to FINGERPRINT hex digits. Keys are periods of a session."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("summary_id")), lambda x: F.concat(x, F.lit("\0"))), "")
    return s.groupBy(*keys).agg(F.count("*").alias("n_leaves"), F.substring(F.sha2(ids, 256), 1, FINGERPRINT).alias("fingerprint"))


def stratum_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of each stratum, and of all as `overall`."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    return scores.groupBy("stratum").agg(F.count("*").alias("n"), *means).union(scores.agg(F.lit("overall").alias("stratum"), F.count("*").alias("n"), *means))


def drift(a: DataFrame, b: DataFrame, noise_sd: float | None = None) -> DataFrame:
    """(query_id, delta, verdict) between two runs (query_id, quality, rr), a before b.

    A query is compared by quality if both runs have it, else by reciprocal rank if both do, else not at all. It drifts if it
    changed by more than twice the noise, or at all where the noise isn't known. Queries of one run alone stay, without a delta.
    """
    both = a.select("query_id", F.col("quality").alias("qa"), F.col("rr").alias("ra")).join(b.select("query_id", F.col("quality").alias("qb"), F.col("rr").alias("rb")), "query_id", "full")
    delta = F.round(F.coalesce(F.col("qb") - F.col("qa"), F.col("rb") - F.col("ra")), 6)
    least = 2 * (noise_sd or 0.0)
    return both.select("query_id", delta.alias("delta")).withColumn("verdict", F.when(F.col("delta").isNull(), "not compared").when(F.abs("delta") <= least, "same").when(F.col("delta") > 0, "improved").otherwise("regressed"))


def stratum_drift(drifted: DataFrame, strata: DataFrame, noise_sd: float | None = None) -> DataFrame:
    """(stratum, n_scored, improved, regressed, cumulative, fell): drift by stratum of (query_id, stratum); queries without one are `unknown`.

    A stratum fell if its deltas sum to less than minus twice the noise.
    """
    lined = drifted.join(strata.select("query_id", "stratum"), "query_id", "left").withColumn("stratum", F.coalesce("stratum", F.lit("unknown")))
    sums = lined.groupBy("stratum").agg(F.count("delta").alias("n_scored"), F.count_if(F.col("verdict") == "improved").alias("improved"), F.count_if(F.col("verdict") == "regressed").alias("regressed"), F.round(F.coalesce(F.sum("delta"), F.lit(0.0)), 6).alias("cumulative"))
    return sums.withColumn("fell", F.col("cumulative") < -2 * (noise_sd or 0.0))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored without the keys of new, and new."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def link_once(links: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """links and those of new that aren't there yet, each once, with ordinals that go on behind a node's last."""
    fresh = new.select(*keys).distinct().join(links.select(*keys), keys, "left_anti")
    last = links.groupBy(keys[0]).agg(F.max("ordinal").alias("last"))
    w = Window.partitionBy(keys[0]).orderBy(keys[1])
    added = fresh.join(last, keys[0], "left").select(*keys, (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).cast("long").alias("ordinal"))
    return links.select(*keys, F.col("ordinal").cast("long").alias("ordinal")).union(added)
