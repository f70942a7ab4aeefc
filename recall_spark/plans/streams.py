"""Registered queries that run streams over the given tables, each with the SQL of its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recall_spark.functions.text import estimate_tokens
from recall_spark.plans.queries import _PACK, _RAW, query
from recall_spark.sources import views as V
from recall_spark.sources.shared import shared_dir
from recall_spark.streaming import jobs as J


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    return spark.readStream.schema(V.read(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")  # a pattern, as the table may be a file or a folder


def _rows(spark, path):
    return spark.read.parquet(f"{path}/rows").drop("batch")


@query("z1_stream_ingest", "messages", " SELECT conversation_id, seq, role, sha256(role || chr(0) || content) AS identity_hash FROM messages")
def _(spark, d):
    path = _folder(spark)
    c = _stream(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.expr(f"timestampadd(MINUTE, cast(conv_id * 60 + turn as int), {V.START})").alias("created_at"))
    J.ingest_into(c.union(c), f"{path}/rows", f"{path}/checkpoint", "3650 days").awaitTermination()
    return _rows(spark, path).select("conversation_id", "seq", "role", "identity_hash")


@query("z2_stream_leaf_chunks", "items", _RAW + _PACK.format(src="raw", b=100) + "SELECT conversation_id, ordinal, chunk FROM p")
def _(spark, d):
    path = _folder(spark)
    m = _stream(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), estimate_tokens("text").alias("token_count"))
    J.chunks_into(m, f"{path}/rows", f"{path}/checkpoint", 2, 100).awaitTermination()
    return _rows(spark, path).select("conversation_id", "ordinal", "chunk")


@query("z3_stream_backlog", "", "SELECT 'sum_' || doc_id AS summary_id, sha256(text) AS content_hash FROM documents WHERE ceil(0.25 * length(text)) BETWEEN 20 AND 800")
def _(spark, d):
    path = _folder(spark)
    s = _stream(spark, d, "documents").select(F.concat(F.lit("sum_"), "doc_id").alias("summary_id"), F.lit("leaf").alias("kind"), estimate_tokens("text").alias("token_count"), F.lit(None).cast("timestamp").alias("suppressed_at"), F.col("text").alias("content"))
    work = lambda rows: rows.select("summary_id", F.sha2("content", 256).alias("content_hash"))
    J.backlog(s, work, f"{path}/rows", f"{path}/checkpoint", 20, 800).awaitTermination()
    return _rows(spark, path)
