"""Reading, scoping, ingesting and counting messages and conversations, for all conversations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.text import db_role, estimate_tokens, identity_hash


def read_messages(m: DataFrame, after_seq: int, limit: int) -> DataFrame:
    """The first messages of each conversation behind a seq."""
    w = Window.partitionBy("conversation_id").orderBy("seq", "message_id")
    return m.where(F.col("seq") > after_seq).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def append_messages(m: DataFrame, new: DataFrame) -> DataFrame:
    """new (conversation_id, position, role, content) with seq behind the stored ones, hash and tokens."""
    last = m.groupBy("conversation_id").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("conversation_id").orderBy("position")
    lined = new.join(last, "conversation_id", "left").withColumn("seq", F.coalesce("last", F.lit(-1)) + F.row_number().over(w))
    return lined.select("conversation_id", "seq", db_role("role").alias("role"), identity_hash(db_role("role"), "content").alias("identity_hash"), estimate_tokens("content").alias("token_count"))


def scope_filter(df: DataFrame, ids: list[int] | None = None, one: int | None = None) -> DataFrame:
    """A list of conversations wins over a single one; without either, all."""
    wanted = list(dict.fromkeys(ids or ([] if one is None else [one])))
    return df.where(F.col("conversation_id").isin(wanted)) if wanted else df


def conversation_family(convs: DataFrame) -> DataFrame:
    """Conversations by family (same session_key, or same session_id where the key is blank), active and newest first."""
    family = F.coalesce(F.nullif(F.trim("session_key"), F.lit("")), F.concat(F.lit("id:"), "session_id"))
    w = Window.partitionBy("family").orderBy(F.desc("active"), F.desc("conversation_id"))
    return convs.withColumn("family", family).withColumn("position", F.row_number().over(w))


def time_filter(df: DataFrame, since: str, before: str, column: str = "created_at") -> DataFrame:
    return df.where((F.col(column) >= F.lit(since).cast("timestamp")) & (F.col(column) < F.lit(before).cast("timestamp")))


def visible(df: DataFrame) -> DataFrame:
    return df.where("suppressed_at is null")


def role_filter(df: DataFrame, role: str) -> DataFrame:
    return df if role == "all" else df.where(F.col("role") == role)


def drop_sessions(convs: DataFrame, patterns: list[str]) -> DataFrame:
    """Conversations whose key (else id) no pattern finds."""
    name = F.coalesce("session_key", "session_id")
    hit = F.lit(False)
    for p in patterns:
        hit = hit | name.rlike(p)
    return convs.where(~hit)


def persistable(m: DataFrame) -> DataFrame:
    """Messages of known roles, without empty assistant turns."""
    return m.where(F.col("role").isin("user", "assistant", "system", "tool", "toolResult")).where((F.col("role") != "assistant") | (F.trim("content") != ""))


def identity_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("conversation_id", identity_hash("role", "content").alias("identity_hash")).agg(F.count("*").alias("copies"))


def conversation_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), F.max("seq").alias("max_seq"), F.max_by("role", "seq").alias("last_role"), F.sum("token_count").alias("tokens"))


def first_message(m: DataFrame) -> DataFrame:
    """Preview of each conversation's first message: only 256 characters are aggregated."""
    return m.groupBy("conversation_id").agg(F.min_by(F.substring("content", 1, 256), F.struct("seq", "message_id")).alias("preview"), F.count("*").alias("n_messages"))


def replay_cursor(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many incoming messages, from the first on, a conversation has stored already."""
    both = stored.select("conversation_id", "seq", identity_hash("role", "content").alias("a")).join(incoming.select("conversation_id", "seq", identity_hash("role", "content").alias("b")), ["conversation_id", "seq"], "right")
    return both.groupBy("conversation_id").agg(F.coalesce(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("seq"))), F.max("seq") + 1).alias("cursor"))


def legacy_candidates(convs: DataFrame, s: DataFrame) -> DataFrame:
    """Conversations without a session key, with their leaves."""
    leaves = s.groupBy("conversation_id").agg(F.count("*").alias("n"))
    return convs.where("session_key is null").join(leaves, "conversation_id", "left").groupBy(F.concat(F.lit("legacy:conv_"), "conversation_id").alias("legacy_key")).agg(F.countDistinct("conversation_id").alias("n_conversations"), F.sum(F.coalesce("n", F.lit(0))).alias("n_leaves"))


def backfill_session_keys(convs: DataFrame) -> DataFrame:
    return convs.withColumn("session_key", F.coalesce("session_key", F.concat(F.lit("legacy:conv_"), "conversation_id")))


def reconcile_keys(convs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with keys merged by mapping (old_key, new_key), keys that would have several active conversations)."""
    merged = convs.join(mapping, F.col("session_key") == F.col("old_key"), "left").withColumn("session_key", F.coalesce("new_key", "session_key")).drop("old_key", "new_key")
    conflicts = merged.where("active = 1 and session_key is not null").groupBy("session_key").agg(F.count("*").alias("n_active")).where("n_active > 1")
    return merged, conflicts


def store_status(s: DataFrame) -> DataFrame:
    return s.agg(F.count("*").alias("n"), F.countDistinct("conversation_id").alias("n_conversations"), F.sum("token_count").alias("tokens"), F.count_if(F.col("suppressed_at").isNotNull()).alias("n_suppressed"), F.sum(F.when(F.col("suppressed_at").isNull(), F.col("token_count"))).alias("visible_tokens"))


def compression_ratio(context: str, compressed: str):
    """1:N with N = max(1, compressed / context), half to even."""
    return F.concat(F.lit("1:"), F.greatest(F.lit(1), F.bround(F.col(compressed) / F.col(context)).cast("long")))
