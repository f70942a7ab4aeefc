"""Streams from files, with files sent twice and restarts, against their batch twins."""

import pytest
from pyspark.sql import functions as F

from recall_spark.operators import windows as W
from recall_spark.sources import views as V
from recall_spark.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, tmp_path):
    """Messages in three files by seq; later files hold later messages."""
    m = V.messages(spark, SF)
    write = lambda name, cond: m.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))
    return m, write, tmp_path


def stream(spark, m, path):
    return spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chunks_as_messages_leave_the_tail(spark, parts):
    m, write, path = parts
    run = lambda: J.chunks_into(stream(spark, m, path), f"{path}/out", f"{path}/checkpoint", 2, 100).awaitTermination()
    write("a", "seq < 3")
    run()
    write("b", "seq >= 3 and seq < 5")
    write("b", "seq = 4")  # sent again while in the tail
    run()  # a new query on the same checkpoint
    write("c", "seq >= 5")
    run()
    out = spark.read.parquet(f"{path}/out")
    items = m.select("conversation_id", F.col("seq").alias("ordinal"), "token_count")
    assert rows(out.where("chunk is not null").select("conversation_id", "ordinal", "chunk")) == rows(W.plan_leaf_chunks(items, 2, 100))
    late = {(r.conversation_id, r.ordinal) for r in out.where("chunk is null").collect()}
    assert all(o == 4 for _, o in late)  # only what was sent again after it had left the tail
    assert out.where("due").count() > 0
    run()  # nothing new
    assert spark.read.parquet(f"{path}/out").count() == out.count()


def test_ingest_of_files_sent_twice_and_a_batch_that_was_cut_off(spark, parts):
    m, write, path = parts
    write("a", "seq < 2")
    write("b", "seq < 4")  # again, with more
    ask = lambda: J.ingest_into(stream(spark, m, path), f"{path}/out", f"{path}/checkpoint", "3650 days").awaitTermination()
    ask()
    last = max(int(p.name.removeprefix("batch=")) for p in (path / "out").glob("batch=*"))
    for f in (path / "checkpoint" / "commits").glob(f"*{last}*"):
        f.unlink()  # as if the query had been lost before it noted its last batch
    ask()
    out = spark.read.parquet(f"{path}/out").select("message_id")
    assert rows(out) == rows(m.where("seq < 4").select("message_id"))


def test_backlog_takes_each_summary_once(spark, tmp_path):
    s = V.summaries(spark, SF)
    for i, cond in enumerate(("doc_id < 90", "doc_id >= 60 and doc_id < 150", "doc_id % 2 = 0")):
        s.where(cond).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    work = lambda r: r.select("summary_id", F.length("content").alias("n"))
    J.backlog(source, work, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 20, 800).awaitTermination()
    want = s.where("(doc_id < 150 or doc_id % 2 = 0) and suppressed_at is null and token_count between 20 and 800")
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("summary_id", "n")) == rows(want.select("summary_id", F.length("content").alias("n")))


def test_activity_as_a_stream(spark, tmp_path):
    e = V.read(spark, SF, "events")
    at = F.col("ts").cast("timestamp")
    source = spark.readStream.schema(e.schema).parquet(f"{SF}/events[.]parquet").withColumn("ts", at)
    e = e.withColumn("ts", at)
    q = J.activity(source, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("seen").select("window.start", "event_type", "n")) == rows(J.activity(e, "ts", "event_type").select("window.start", "event_type", "n"))
