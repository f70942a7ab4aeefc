"""Checks, suppression, duplicates, entities, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Markers of damaged summaries and the distance from the end within which they count.
FALLBACK_MARKER, FALLBACK_WINDOW = "[LCM fallback summary; truncated for context management]", 80
TRUNCATED_PREFIX, TRUNCATED_WINDOW = "[Truncated from ", 40


def check_contiguous(items: DataFrame, order: str) -> DataFrame:
    """Conversations whose ordinals, from their least on, leave gaps or repeat."""
    return items.groupBy("conversation_id").agg(F.count("*").alias("n"), F.countDistinct(order).alias("kinds"), (F.max(order) - F.min(order) + 1).alias("width")).where("n <> kinds or kinds <> width").select("conversation_id", (F.col("width") - F.col("kinds")).alias("missing"), (F.col("n") - F.col("kinds")).alias("repeated"))


def check_references(items: DataFrame, m: DataFrame) -> DataFrame:
    """Items whose message isn't there."""
    return items.join(m.select("message_id"), "message_id", "left_anti").groupBy("conversation_id").agg(F.count("*").alias("dangling"))


def duplicate_clusters(items: DataFrame, hash_column: str, k: int = 5) -> DataFrame:
    groups = items.groupBy("conversation_id", hash_column).agg(F.count("*").alias("copies"), F.sum("token_count").alias("tokens")).where("copies > 1")
    w = Window.partitionBy("conversation_id").orderBy(F.desc("tokens"), F.desc("copies"), hash_column)
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def damage(content: str) -> Column:
    """old: the text starts with the fallback marker; truncated, fallback: it has the truncation mark or the marker near its end; else null."""
    at = lambda mark: F.instr(content, mark)
    near = lambda mark, window: (at(mark) > 0) & (F.length(content) - at(mark) + 1 < window)
    return F.when(F.startswith(content, F.lit(FALLBACK_MARKER)), "old").when(near(TRUNCATED_PREFIX, TRUNCATED_WINDOW), "truncated").when(near(FALLBACK_MARKER, FALLBACK_WINDOW), "fallback")


def damaged_summaries(s: DataFrame) -> DataFrame:
    """Damaged summaries, with the kind of damage."""
    return s.withColumn("damage", damage("content")).where("damage is not null")


def suppress(s: DataFrame, chosen: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries still visible, nodes that have a suppressed source)."""
    return s.join(chosen.select("summary_id"), "summary_id", "left_anti"), edges.join(chosen.select(F.col("summary_id").alias("source_summary_id")), "source_summary_id", "left_semi").select("summary_id").distinct()


def suppress_everywhere(summaries: DataFrame, edges: DataFrame, links: DataFrame, context: DataFrame, caches: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """What goes or changes when leaves (chosen: summary_id) are suppressed, by table.

    summaries (summary_id, suppressed), edges (summary_id, source_summary_id), links (summary_id, message_id), context
    (conversation_id, ordinal, item_type, ref), caches (cache_id, summary_id). hidden: the leaves; flagged: condensed summaries over one; messages:
    those that no other visible leaf covers; items: context items of the leaves and of all their messages; caches: those that refer to one.
    """
    ids = chosen.select("summary_id").distinct()
    covered = links.join(ids, "summary_id", "left_semi").select("message_id").distinct()
    others = links.join(summaries.where(~F.col("suppressed")).select("summary_id"), "summary_id", "left_semi").join(ids, "summary_id", "left_anti").select("message_id").distinct()
    refs = ids.select(F.lit("summary").alias("item_type"), F.col("summary_id").alias("ref")).union(covered.select(F.lit("message"), F.col("message_id").cast("string")))
    return {
        "hidden": summaries.join(ids, "summary_id", "left_semi").select("summary_id"),
        "flagged": edges.join(ids.withColumnRenamed("summary_id", "source_summary_id"), "source_summary_id", "left_semi").select("summary_id").distinct(),
        "messages": covered.join(others, "message_id", "left_anti"),
        "items": context.join(refs, ["item_type", "ref"], "left_semi").select("conversation_id", "ordinal"),
        "caches": caches.join(ids, "summary_id", "left_semi").select("cache_id").distinct(),
    }


def scan_cleaners(convs: DataFrame, m: DataFrame) -> DataFrame:
    """Conversations by cleaning rule, with messages and the three largest as examples."""
    rule = F.when((F.col("active") == 0) & F.startswith("session_key", F.lit("agent:main:subagent:")), "archived_subagent").when(F.startswith("session_key", F.lit("agent:main:cron:")), "cron").when(F.col("session_key").isNull(), "null_key")
    sizes = m.groupBy("conversation_id").agg(F.count("*").alias("n"))
    hit = convs.withColumn("rule", rule).where("rule is not null").join(sizes, "conversation_id")
    w = Window.partitionBy("rule").orderBy(F.desc("n"), "conversation_id")
    return hit.withColumn("rank", F.row_number().over(w)).groupBy("rule").agg(F.count("*").alias("n_conversations"), F.sum("n").alias("n_messages"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.col("conversation_id").cast("string")))), ",").alias("examples"))


def extract_entities(s: DataFrame, rules: dict[str, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(session_key, summary_id, type, surface, ...) for every match of every rule, with columns to carry along; texts are read once."""
    matches = lambda kind, pattern: F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("type"), m.alias("surface")))
    found = F.flatten(F.array(*[matches(t, p) for t, p in rules.items()]))
    return s.select("session_key", "summary_id", *carry, F.explode(found).alias("x")).select("session_key", "summary_id", "x.type", "x.surface", *carry)


def resolve_entities(found: DataFrame) -> DataFrame:
    """Entities by session and folded surface, with counts over different (leaf, surface) mentions."""
    mentions = found.distinct()
    return mentions.groupBy("session_key", F.lower("surface").alias("entity")).agg(F.count("*").alias("occurrences"), F.min("summary_id").alias("first_summary"), F.countDistinct("surface").alias("n_surfaces"), F.min("type").alias("type"))


def extract_tool_columns(parts: DataFrame, paths: list[str]) -> DataFrame:
    return parts.withColumn("value", F.coalesce(*[F.get_json_object("metadata", p) for p in paths]))


def period_bounds(df: DataFrame, now: str, zone: str) -> DataFrame:
    """Bounds of the calendar day and week of a timestamp column `now` in a zone, as UTC timestamps; days may have 23 or 25 hours."""
    local = F.from_utc_timestamp(now, zone)
    to_utc = lambda c: F.to_utc_timestamp(c, zone)
    day, week = F.date_trunc("day", local), F.date_trunc("week", local)
    return df.select("*", to_utc(day).alias("day_since"), to_utc(day + F.expr("interval 1 day")).alias("day_before"), to_utc(week).alias("week_since"), to_utc(week + F.expr("interval 7 days")).alias("week_before"))


def period_rollup(s: DataFrame, tier: str) -> DataFrame:
    return s.groupBy("session_key", F.date_format(F.date_trunc(tier, "created_at"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n_leaves"), F.sum("token_count").alias("tokens"))


def bounded_source(s: DataFrame, cap: int) -> DataFrame:
    """Leaves of each session, oldest first, while their tokens fit the cap."""
    w = Window.partitionBy("session_key").orderBy("created_at", "summary_id").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("running", F.sum("token_count").over(w)).where(F.col("running") <= cap).groupBy("session_key").agg(F.count("*").alias("n_used"), F.max("running").alias("tokens"))


def debt_state(events: DataFrame) -> DataFrame:
    """Latest event of each user."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))
