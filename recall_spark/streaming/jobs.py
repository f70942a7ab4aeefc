"""Streams: ingest without replays, leaf chunks as messages leave the tail, a backlog of summaries, activity by time.

Sinks write one folder a batch and overwrite it, so a batch that was cut off and runs again leaves its rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recall_spark.functions.text import identity_hash

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Messages of a stream (conversation_id, seq, role, content, created_at), each once however often it is sent."""
    return stream.withColumn("identity_hash", identity_hash("role", "content")).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["conversation_id", "seq", "identity_hash"])


def activity(stream: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows by key and time window; works on batches alike."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def _written(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame], once: bool) -> StreamingQuery:
    """Each batch's step(rows, batch number), written over the batch's folder."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_into(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Messages of a stream, each once, in folders by batch under path."""
    return _written(ingest(stream, delay), path, checkpoint, lambda rows, _: rows, once)


def earlier(spark: SparkSession, path: str, number: int, schema) -> DataFrame:
    """Rows that batches before this one wrote under path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") < number) if number else spark.createDataFrame([], schema)


def backlog(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, low: int, high: int, once: bool = True) -> StreamingQuery:
    """Summaries of a stream (summary_id, kind, token_count, suppressed_at, ...) that work still has to be done on.

    Visible leaves in the token range that no earlier batch has under path, each once, are handed to work, which keeps
    summary_id; what it returns is written under path. A batch that runs again sees only what batches before it wrote.
    """

    def step(rows: DataFrame, number: int) -> DataFrame:
        done = earlier(rows.sparkSession, path, number, "summary_id string, batch long").select("summary_id")
        open_ = rows.where("suppressed_at is null and kind = 'leaf'").where(F.col("token_count").between(low, high))
        return work(open_.dropDuplicates(["summary_id"]).join(done, "summary_id", "left_anti"))

    return _written(stream, path, checkpoint, step, once)


CHUNKS = "conversation_id long, ordinal long, chunk long, raw_tokens long, due boolean"


class LeafChunks(StatefulProcessor):
    """Gives each message its leaf chunk when it leaves the tail.

    A conversation's state is the messages of its tail (at most `tail`) and the open chunk: its number, its tokens, all
    tokens outside the tail and the last seq that left. Messages that come again while in the tail are ignored; those at or before the
    last that left are late and come out at once without a chunk, so nothing is lost. An idle conversation's state goes after `ttl_ms`.
    """

    def __init__(self, tail: int, budget: int, ttl_ms: int | None = None):
        self.tail, self.budget, self.ttl_ms = tail, budget, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long, tokens long", ttlDurationMs=self.ttl_ms)
        self.open = handle.getValueState("open", "chunk long, used long, raw long, last long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(self.held.get())
        chunk, used, raw, last = self.open.get() if self.open.exists() else (0, 0, 0, -1)
        late = []
        for part in rows:
            for seq, tokens in zip(part["seq"].tolist(), part["token_count"].fillna(0).astype("int64").tolist(), strict=True):
                if seq <= last:
                    late.append(seq)
                else:
                    held.setdefault(seq, tokens)
        out = [(key[0], seq, None, raw, raw >= self.budget) for seq in late]
        order = sorted(held)
        for seq in order[: max(0, len(order) - self.tail)]:
            tokens = held.pop(seq)
            if used and used + tokens > self.budget:
                chunk, used = chunk + 1, 0
            used, raw, last = used + tokens, raw + tokens, seq
            out.append((key[0], seq, chunk, raw, raw >= self.budget))
        self.held.put(sorted(held.items())) if held else self.held.clear()
        self.open.update((chunk, used, raw, last))
        yield pd.DataFrame(out, columns=["conversation_id", "ordinal", "chunk", "raw_tokens", "due"]).astype({"chunk": "Int64"})

    def close(self) -> None:
        pass


def leaf_chunks(stream: DataFrame, tail: int, budget: int, ttl_ms: int | None = None) -> DataFrame:
    """(conversation_id, ordinal, chunk, raw_tokens, due) of a stream of messages (conversation_id, seq, token_count): the chunks of the batch twin, as messages leave the tail.

    due says whether the messages outside the tail make a chunk yet. The session's state store has to be RocksDB's (STATE_STORE).
    """
    m = stream.select(F.col("conversation_id").cast("long").alias("conversation_id"), F.col("seq").cast("long").alias("seq"), F.col("token_count").cast("long").alias("token_count"))
    return m.groupBy("conversation_id").transformWithStateInPandas(statefulProcessor=LeafChunks(tail, budget, ttl_ms), outputStructType=CHUNKS, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def chunks_into(stream: DataFrame, path: str, checkpoint: str, tail: int, budget: int, ttl_ms: int | None = None, once: bool = True) -> StreamingQuery:
    """leaf_chunks written in folders by batch under path."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        return _written(leaf_chunks(stream, tail, budget, ttl_ms), path, checkpoint, lambda rows, _: rows, once)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
