"""Compaction of contexts into a summary graph, for all conversations at once.

A context is a table of items (conversation_id, ordinal, item_type, ref, depth, token_count, earliest_at, latest_at,
content, descendants, descendant_tokens, source_tokens). Messages have a null depth. Chunks are cut inside islands, which
are runs of neighbours of one type and depth before the fresh tail. A conversation's items are sorted in one task, which
streams them; a conversation isn't split, since where a chunk starts depends on all before it.

Nulls: a null token count is 0, rows without a conversation_id stay as they are. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.text import estimate_tokens
from recall_spark.operators.context import fallback_summary
from recall_spark.operators.windows import greedy_pack
from recall_spark.sources.shared import kept

ITEM = ["conversation_id", "ordinal", "item_type", "ref", "depth", "token_count", "earliest_at", "latest_at", "content", "descendants", "descendant_tokens", "source_tokens"]


@dataclass(frozen=True)
class Policy:
    """Sizes in tokens and items that compaction goes by."""

    tail: int = 8
    chunk: int = 20_000
    condensed_chunk: int = 20_000
    leaf_fanout: int = 8
    condensed_fanout: int = 4
    condensed_target: int = 2_000
    text_target: int = 600
    budget: int = 128_000
    share: float = 0.75
    # Fixed value: least share of a leaf chunk that condensation needs as input.
    least_share: float = 0.1

    @property
    def threshold(self) -> int:
        return int(self.share * self.budget)

    @property
    def least_input(self) -> int:
        return max(self.condensed_target, int(self.least_share * self.condensed_chunk))


def message_items(m: DataFrame) -> DataFrame:
    """Messages (conversation_id, seq, message_id, content, token_count, created_at) as context items."""
    zero = F.lit(0).cast("long")
    return m.select("conversation_id", F.col("seq").alias("ordinal"), F.lit("message").alias("item_type"), F.col("message_id").cast("string").alias("ref"), F.lit(None).cast("int").alias("depth"), F.coalesce("token_count", F.lit(0)).cast("long").alias("token_count"), F.col("created_at").alias("earliest_at"), F.col("created_at").alias("latest_at"), "content", zero.alias("descendants"), zero.alias("descendant_tokens"), F.coalesce("token_count", F.lit(0)).cast("long").alias("source_tokens"))


def islands(items: DataFrame, tail: int) -> DataFrame:
    """Items before the newest `tail` with island: runs of neighbours of one type and depth, numbered from the newest on."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"), F.desc("ref"))
    same = F.struct("item_type", "depth")
    starts = (~same.eqNullSafe(F.lag(same).over(newest))).cast("int")
    ranked = items.withColumn("rn", F.row_number().over(newest)).withColumn("starts", starts)
    return ranked.withColumn("island", F.sum("starts").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("rn") > tail).drop("rn", "starts")


def leaf_chunks(items: DataFrame, tail: int, budget: int) -> DataFrame:
    """(conversation_id, ordinal, ref, token_count, chunk): every leaf chunk of every conversation, numbered from the oldest on.

    A chunk lies within one island of messages, closes when it is full or the next message would exceed the budget, and holds at least one.
    """
    raw = islands(items, tail).where("item_type = 'message'").select("conversation_id", "ordinal", "ref", "token_count", (-F.col("island")).alias("run"))
    packed = greedy_pack(raw, ["conversation_id", "run"], "ordinal", "token_count", budget, close_on_fill=True)
    chunk = F.dense_rank().over(Window.partitionBy("conversation_id").orderBy("run", "chunk")) - 1
    return packed.withColumn("chunk", chunk.cast("long")).drop("run")


def condensed_chunks(items: DataFrame, policy: Policy, hard: bool = False) -> DataFrame:
    """(conversation_id, ordinal, depth, ...): members of the oldest chunk of summaries of each depth, with n, tokens and whether it may be condensed.

    The chunk is the start of the depth's oldest island, up to the budget. Leaves need leaf_fanout members, deeper ones
    condensed_fanout, two when `hard`; all need least_input tokens.
    """
    s = islands(items, policy.tail).where("item_type = 'summary'")
    by = Window.partitionBy("conversation_id", "depth")
    s = s.withColumn("oldest", F.max("island").over(by)).where("island = oldest")
    running = F.sum("token_count").over(by.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(by.orderBy("ordinal"))
    full = F.col("running") - F.col("token_count") >= policy.condensed_chunk
    s = s.withColumns({"running": running, "place": place}).where((F.col("place") == 1) | ((F.col("running") <= policy.condensed_chunk) & ~full))
    s = s.withColumns({"n": F.count("*").over(by), "tokens": F.sum("token_count").over(by)})
    fanout = F.lit(2) if hard else F.when(F.col("depth") == 0, policy.leaf_fanout).otherwise(policy.condensed_fanout)
    return s.withColumn("eligible", (F.col("n") >= fanout) & (F.col("tokens") >= policy.least_input)).drop("island", "oldest", "running", "place")


def condensation_candidates(items: DataFrame, policy: Policy, hard: bool = False) -> DataFrame:
    """Members of the shallowest chunk that may be condensed, of each conversation that has one."""
    c = condensed_chunks(items, policy, hard).where("eligible")
    return c.withColumn("least", F.min("depth").over(Window.partitionBy("conversation_id"))).where("depth = least").drop("least", "eligible")


def source_text(header: Column, content: str = "content") -> Column:
    """Blocks of header and text in order, of a chunk's members; a chunk's budget bounds them."""
    blocks = F.array_sort(F.collect_list(F.struct("ordinal", F.concat(header, F.lit("\n"), F.coalesce(content, F.lit(""))).alias("t"))))
    return F.array_join(F.transform(blocks, lambda r: r["t"]), "\n\n")


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def build_summaries(members: DataFrame, keys: list[str], depth: Column, header: Column, target: int) -> DataFrame:
    """One summary item for each chunk of members (items): text without a model, time range, totals of what it was made from."""
    condensed = F.col("item_type") == "summary"
    own = members.groupBy(*keys).agg(
        F.min("ordinal").alias("ordinal"), depth.cast("int").alias("depth"), F.min("earliest_at").alias("earliest_at"), F.max("latest_at").alias("latest_at"), source_text(header).alias("source"), F.sum("token_count").alias("removed"), F.count("*").alias("n"),
        F.sum(F.when(condensed, F.col("descendants") + 1).otherwise(0)).alias("descendants"), F.sum(F.when(condensed, F.col("descendant_tokens") + F.col("token_count")).otherwise(0)).alias("descendant_tokens"), F.sum("source_tokens").alias("source_tokens"),
    )
    text = fallback_summary("source", target)
    return own.withColumn("content", text).withColumn("token_count", estimate_tokens("content").cast("long")).withColumn("item_type", F.lit("summary")).drop("source")


def sweep_leaves(items: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, summaries with their conversations' running tokens, (ref, source_ref, ordinal) edges) after all leaf passes.

    A conversation is swept if its context is beyond the threshold or its messages before the tail make a chunk; passes
    go on, oldest chunk first, until the context is not beyond the threshold or a pass gains nothing.
    """
    chunks = leaf_chunks(items, policy.tail, policy.chunk)
    raw = chunks.groupBy("conversation_id").agg(F.sum("token_count").alias("raw"))
    stored = items.groupBy("conversation_id").agg(F.sum("token_count").alias("before"))
    due = stored.join(raw, "conversation_id").where((F.col("before") > policy.threshold) | (F.col("raw") >= policy.chunk)).select("conversation_id", "before")
    members = chunks.select("conversation_id", "ordinal", "chunk").join(items, ["conversation_id", "ordinal"]).join(due, "conversation_id")
    header = F.concat(F.lit("["), stamp("earliest_at"), F.lit("]"))
    leaves = build_summaries(members, ["conversation_id", "chunk", "before"], F.lit(0), header, policy.text_target)
    passes = Window.partitionBy("conversation_id").orderBy("chunk")
    running = F.col("before") + F.sum(F.col("token_count") - F.col("removed")).over(passes.rowsBetween(Window.unboundedPreceding, 0))
    stops = (F.col("running") <= policy.threshold) | (F.col("token_count") >= F.col("removed"))
    earlier = F.coalesce(F.sum("stops").over(passes.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leaves = leaves.withColumn("running", running).withColumn("stops", stops.cast("int")).withColumn("earlier", earlier).where("earlier = 0")
    leaves = kept(leaves.withColumn("ref", F.concat_ws("_", F.lit("sum"), "conversation_id", F.lit("0"), "chunk")).drop("earlier"))
    taken = kept(members.join(leaves.select("conversation_id", "chunk", F.col("ref").alias("made")), ["conversation_id", "chunk"]).select("conversation_id", "ordinal", F.col("ref").alias("source_ref"), F.col("made").alias("ref")))
    return after_passes(items, taken, leaves), leaves, numbered(taken)


def numbered(taken: DataFrame) -> DataFrame:
    """(ref, source_ref, ordinal): edges with the sources' order from 0."""
    place = F.row_number().over(Window.partitionBy("ref").orderBy("ordinal")) - 1
    return taken.select("ref", "source_ref", place.cast("long").alias("ordinal"))


def after_passes(items: DataFrame, taken: DataFrame, made: DataFrame) -> DataFrame:
    """Items without what was taken (conversation_id, ordinal), with what was made in its place, numbered again from 0."""
    rest = items.join(taken.select("conversation_id", "ordinal"), ["conversation_id", "ordinal"], "left_anti").select(*ITEM)
    every = rest.unionByName(made.select(*ITEM))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ordinal", "ref")) - 1
    return every.withColumn("ordinal", place.cast("long"))


def condense(members: DataFrame, policy: Policy, number: int) -> tuple[DataFrame, DataFrame]:
    """(summaries, (conversation_id, ordinal, source_ref, ref) of their sources) of one pass over candidates' members."""
    header = F.concat(F.lit("["), stamp("earliest_at"), F.lit(" - "), stamp("latest_at"), F.lit("]"))
    made = build_summaries(members, ["conversation_id"], F.max(F.col("depth")) + 1, header, policy.text_target)
    made = kept(made.withColumn("ref", F.concat_ws("_", F.lit("sum"), "conversation_id", F.lit(str(number)), F.lit("0"))))
    return made, members.join(made.select("conversation_id", F.col("ref").alias("made")), "conversation_id").select("conversation_id", "ordinal", F.col("ref").alias("source_ref"), F.col("made").alias("ref"))


def compact(items: DataFrame, policy: Policy, hard: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, summaries, edges) after a full sweep of every conversation: leaf passes, then condensation a pass a round.

    A conversation leaves the loop when its context isn't beyond the threshold, a pass gains nothing or no chunk may be
    condensed. Only conversations still in the loop are read and written again; a round's tables are written, so a lost
    executor costs one round. Every pass takes at least two items for one, so the loop ends.
    """
    swept, leaves, edges = sweep_leaves(items, policy)
    swept = kept(swept)
    at_end = leaves.groupBy("conversation_id").agg(F.max_by("running", "chunk").alias("running"), F.max_by("stops", "chunk").alias("stopped"), F.max_by(F.col("running") - F.col("token_count") + F.col("removed"), "chunk").alias("last"))
    stored = items.groupBy("conversation_id").agg(F.sum("token_count").alias("before"))
    previous = F.when(F.col("running").isNull(), F.col("before")).when((F.col("running") <= policy.threshold) | (F.col("stopped") == 0), F.col("running")).otherwise(F.col("last"))
    state = kept(stored.join(at_end, "conversation_id", "left").select("conversation_id", F.coalesce("running", "before").alias("running"), previous.alias("previous")).where(F.col("previous") > policy.threshold))
    columns = ["ref", *[c for c in ITEM if c != "ref"], "n", "removed"]
    done, nodes, links, open_, number = [], [leaves.select(*columns)], [edges], swept, 0
    while True:
        number += 1
        asked = open_.join(state.select("conversation_id"), "conversation_id", "left_semi")
        members = kept(condensation_candidates(asked, policy, hard))
        going = members.select("conversation_id").distinct()
        done.append(open_.join(going, "conversation_id", "left_anti"))
        if members.isEmpty():
            break
        made, taken = condense(members, policy, number)
        nodes.append(made.select(*columns))
        links.append(numbered(taken))
        open_ = kept(after_passes(open_.join(going, "conversation_id", "left_semi"), taken, made))
        now = F.col("running") - F.col("removed") + F.col("token_count")
        moved = state.join(made.select("conversation_id", "removed", "token_count"), "conversation_id").withColumn("now", now)
        state = kept(moved.where((F.col("now") > policy.threshold) & (F.col("now") < F.col("running")) & (F.col("now") < F.col("previous"))).select("conversation_id", F.col("now").alias("running"), F.col("now").alias("previous")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(done), union(nodes), union(links)
