"""The conversation store as views over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.functions.text import estimate_tokens

START = "timestamp'2024-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 10000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("conversation_id"), F.col("turn").cast("long").alias("seq"), "role",
        F.col("text").alias("content"), estimate_tokens("text").alias("token_count"),
        F.expr(f"timestampadd(MINUTE, cast(conv_id * 60 + turn as int), {START})").alias("created_at"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conversation_id")
    key = F.when(c % 5 == 0, F.concat(F.lit("agent:main:cron:"), c)).when(c % 5 == 1, F.concat(F.lit("agent:main:subagent:"), c)).when(c % 5 == 2, None).otherwise(F.concat(F.lit("team:"), c % 7))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct().select(
        c, F.concat(F.lit("s"), c).alias("session_id"), key.alias("session_key"), (c % 3 == 0).cast("int").alias("active"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as leaf summaries; toxic ones are suppressed."""
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("hidden"))
    d = read(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    return d.select(
        F.concat(F.lit("sum_"), "doc_id").alias("summary_id"), "doc_id", F.expr("cast(substring(source, 4) as bigint)").alias("conversation_id"), F.col("source").alias("session_key"),
        F.lit("leaf").alias("kind"), F.lit(0).alias("depth"), F.col("text").alias("content"), estimate_tokens("text").alias("token_count"),
        F.expr(f"timestampadd(MINUTE, cast(doc_id as int), {START})").alias("created_at"), F.when(F.col("hidden"), F.expr("timestamp'2024-02-01 00:00:00'")).alias("suppressed_at"),
    )


def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.select("conversation_id", F.col("seq").alias("ordinal"), F.lit("message").alias("item_type"), "message_id", "token_count", "role")


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(summaries, edges) of a summary graph over documents: four leaves to a node, four nodes to the next level."""
    leaf = read(spark, sf_dir, "documents").select("doc_id", estimate_tokens("text").alias("token_count"))
    ids = leaf.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.floor(F.col("doc_id") / 4**d).alias("k")) for d in range(4)])).alias("x")).select("x.*").distinct()
    name = lambda d, k: F.concat(F.lit("n"), d, F.lit("_"), k)
    nodes = ids.select(name(F.col("depth"), F.col("k")).alias("summary_id"), "depth")
    edges = ids.where("depth < 3").select(name(F.col("depth") + 1, F.floor(F.col("k") / 4)).alias("summary_id"), name(F.col("depth"), F.col("k")).alias("source_summary_id"), (F.col("k") % 4).alias("ordinal"))
    return nodes, edges


#: The same views for the oracle's SQL.
SQL = {
    "messages": """messages AS (SELECT conv_id * 10000 + turn AS message_id, conv_id AS conversation_id, CAST(turn AS BIGINT) AS seq, role, text AS content,
      CAST(ceil(0.25 * length(text)) AS BIGINT) AS token_count, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT)) AS created_at FROM conversations)""",
    "convs": """convs AS (SELECT conv_id AS conversation_id, 's' || conv_id AS session_id, CASE WHEN conv_id % 5 = 0 THEN 'agent:main:cron:' || conv_id WHEN conv_id % 5 = 1 THEN 'agent:main:subagent:' || conv_id
      WHEN conv_id % 5 = 2 THEN NULL ELSE 'team:' || (conv_id % 7) END AS session_key, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS active FROM (SELECT DISTINCT conv_id FROM conversations))""",
    "summaries": """summaries AS (SELECT 'sum_' || d.doc_id AS summary_id, d.doc_id, CAST(substring(source, 4) AS BIGINT) AS conversation_id, source AS session_key, 'leaf' AS kind, 0 AS depth, text AS content,
      CAST(ceil(0.25 * length(text)) AS BIGINT) AS token_count, TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id AS BIGINT)) AS created_at,
      CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2024-02-01' END AS suppressed_at FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id)""",
    "items": """items AS (SELECT conv_id AS conversation_id, CAST(turn AS BIGINT) AS ordinal, conv_id * 10000 + turn AS message_id, CAST(ceil(0.25 * length(text)) AS BIGINT) AS token_count, role FROM conversations)""",
    "tree": """ids AS (SELECT DISTINCT d AS depth, CAST(floor(doc_id / pow(4, d)) AS BIGINT) AS k FROM documents, range(4) r(d)),
      nodes AS (SELECT 'n' || depth || '_' || k AS summary_id, depth FROM ids),
      edges AS (SELECT 'n' || (depth + 1) || '_' || (k // 4) AS summary_id, 'n' || depth || '_' || k AS source_summary_id, k % 4 AS ordinal FROM ids WHERE depth < 3)""",
}


def with_views(names: str, sql: str) -> str:
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    return f"WITH {recursive}" + ",\n".join(SQL[n] for n in names.split()) + sql.replace("RECURSIVE", "")
