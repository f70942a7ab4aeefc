"""Fresh tails, packing and other work on ordered context items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fresh_tail(items: DataFrame, n: int, max_tokens: int | None = None) -> DataFrame:
    """Newest n items of each conversation, within max_tokens but at least one."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"))
    ranked = items.withColumn("rn", F.row_number().over(w)).withColumn("running", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = F.col("rn") <= n
    if max_tokens is not None:
        keep = keep & ((F.col("rn") == 1) | (F.col("running") <= max_tokens))
    return ranked.where(keep).drop("running")


def leaf_trigger(items: DataFrame, tail: int, chunk: int) -> DataFrame:
    """Tokens outside the tail, and whether they make a chunk."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"))
    out = items.withColumn("rn", F.row_number().over(w)).groupBy("conversation_id").agg(F.coalesce(F.sum(F.when(F.col("rn") > tail, F.col("token_count"))), F.lit(0)).alias("raw_tokens"))
    return out.withColumn("due", F.col("raw_tokens") >= chunk)


def resequence(items: DataFrame) -> DataFrame:
    w = Window.partitionBy("conversation_id").orderBy("ordinal", "message_id")
    return items.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def top_contributors(items: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("conversation_id", "role").orderBy(F.desc("token_count"), "ordinal")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def greedy_pack(items: DataFrame, key: str | list[str], order: str, tokens: str, budget: int, close_on_fill: bool = False) -> DataFrame:
    """items with chunk: a chunk closes when the next item would exceed the budget; an item may exceed it alone.

    close_on_fill: a chunk that reaches the budget takes no more items, not even empty ones. Null or negative counts are 0.
    Where a chunk starts depends on all before it, so a key is folded in order, in one task: its sorted rows are streamed and
    a chunk's end is found in their prefix sums, so no key is ever held whole.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    keys = [key] if isinstance(key, str) else key

    def run(batches):
        now, chunk, used = object(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes = np.maximum(pc.fill_null(batch.column(tokens).cast(pa.int64()), 0).to_numpy(zero_copy_only=False), 0)
            sums = np.concatenate(([0], np.cumsum(sizes)))
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            starts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1).tolist(), n]
            out = np.zeros(n, np.int64)
            for i, end in zip(starts[:-1], starts[1:], strict=True):
                own = tuple(batch.column(k)[i].as_py() for k in keys)
                if own != now:
                    now, chunk, used = own, 0, 0
                while i < end:
                    room = sums[i] + budget - used
                    to = sums.searchsorted(room, "right") - 1
                    if not used:  # the first item with tokens always fits
                        to = max(to, sums.searchsorted(sums[i], "right"))
                    if close_on_fill:
                        to = min(to, max(sums.searchsorted(room, "left"), i if used else i + 1))
                    to = min(to, end)
                    if to <= i:
                        chunk, used = chunk + 1, 0
                        continue
                    out[i:to] = chunk
                    used += int(sums[to] - sums[i])
                    i = to
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "chunk"])

    return items.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, items.withColumn("chunk", F.lit(0).cast("long")).schema)


def greedy_pack_folded(items: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """The same fold as (key, order, chunk), for keys of any length."""
    rows = items.select(key, F.col(order).cast("long").alias(order), F.col(tokens).cast("long").alias(tokens))
    return greedy_pack(rows, key, order, tokens, budget).select(key, order, "chunk")


def plan_leaf_chunks(items: DataFrame, tail: int, budget: int) -> DataFrame:
    """All leaf chunks of all conversations outside their tails."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"))
    raw = items.withColumn("rn", F.row_number().over(w)).where(F.col("rn") > tail)
    return greedy_pack(raw.select("conversation_id", "ordinal", "token_count"), "conversation_id", "ordinal", "token_count", budget).select("conversation_id", "ordinal", "chunk")


def build_leaves(chunks: DataFrame, m: DataFrame) -> DataFrame:
    """One summary row for each chunk."""
    lined = chunks.join(m.select("conversation_id", F.col("seq").alias("ordinal"), "token_count"), ["conversation_id", "ordinal"])
    return lined.groupBy("conversation_id", "chunk").agg(F.count("*").alias("n_messages"), F.sum("token_count").alias("source_tokens"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


def assemble(items: DataFrame, tail: int, budget: int) -> DataFrame:
    """The tail is kept; before it the newest items, up to the first that the budget has no room for."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"))
    ranked = items.withColumn("rn", F.row_number().over(w)).withColumn("running", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("rn") <= tail) | (F.col("running") <= budget)).drop("running")


def overflow_report(items: DataFrame, tail: int, budget: int) -> DataFrame:
    w = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"))
    return items.withColumn("rn", F.row_number().over(w)).groupBy("conversation_id").agg(F.sum("token_count").alias("tokens"), F.sum(F.when(F.col("rn") <= tail, F.col("token_count")).otherwise(0)).alias("tail_tokens")).withColumn("over", F.greatest(F.lit(0), F.col("tokens") - budget))


def leaves_around(s: DataFrame, anchors: DataFrame, hours: int) -> DataFrame:
    """Leaves at most so many hours from an anchor (half-open above), by an equi-join on time bins."""
    width = hours * 3600
    t = F.unix_timestamp("created_at")
    left = anchors.select(F.col("summary_id").alias("anchor_id"), "session_key", t.alias("at")).withColumn("bin", F.explode(F.array(*[F.floor(F.col("at") / width) + i for i in (-1, 0, 1)])))
    right = s.select("summary_id", "session_key", t.alias("t")).withColumn("bin", F.floor(F.col("t") / width))
    return left.join(right, ["session_key", "bin"]).where((F.col("t") >= F.col("at") - width) & (F.col("t") < F.col("at") + width) & (F.col("summary_id") != F.col("anchor_id"))).select("anchor_id", "summary_id")


def cap_by_chars(hits: DataFrame, key: str, order: str, size: str, cap: int) -> DataFrame:
    """The first hits of each key whose sizes, with a line end each, fit the cap."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("running", F.sum(F.col(size) + 1).over(w)).where(F.col("running") <= cap).drop("running")
