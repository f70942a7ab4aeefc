"""Repair of damaged summaries from their sources, for all conversations at once.

Tables: nodes (conversation_id, summary_id, depth, content, earliest_at, latest_at, created_at), edges (summary_id, source_summary_id,
ordinal), links (summary_id, message_id, ordinal), messages (message_id, content, created_at), context (conversation_id, summary_id, ordinal).
A null depth is 0, a null content empty; summary ids are distinct; edges and links to what isn't there count as none; other columns aren't read.
Orders are those of one conversation and depth (or parent), streamed by a window that holds one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.text import estimate_tokens
from recall_spark.operators.compaction import source_text, stamp
from recall_spark.operators.integrity import damage
from recall_spark.operators.records import orphans
from recall_spark.sources.shared import kept

Rewrite = Callable[[Column, Column, Column], Column]


def stripped(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def previous_summaries(nodes: DataFrame, edges: DataFrame, context: DataFrame) -> DataFrame:
    """(summary_id, previous, via): the summary before each one, by the first of three orders that names one with a text.

    context: the one before it in its conversation's context, of its depth; siblings: the source before it of what it was condensed into
    (of several, the least id); time: the one before it by created_at, then id, of its conversation and depth.
    """
    told = F.when(stripped("content") != "", F.col("summary_id"))
    n = nodes.select("conversation_id", "summary_id", F.coalesce("depth", F.lit(0)).alias("depth"), "created_at", told.alias("told"))
    own = Window.partitionBy("conversation_id", "depth")
    placed = context.select("conversation_id", "summary_id", "ordinal").join(n, ["conversation_id", "summary_id"])
    placed = placed.withColumn("p", F.lag("told").over(own.orderBy("ordinal"))).groupBy("summary_id").agg(F.min_by("p", "ordinal").alias("in_context"))
    lined = edges.select(F.col("summary_id").alias("parent"), F.col("source_summary_id").alias("summary_id"), "ordinal").join(n.select("summary_id", "told"), "summary_id")
    lined = lined.withColumn("p", F.lag("told").over(Window.partitionBy("parent").orderBy("ordinal", "summary_id"))).groupBy("summary_id").agg(F.min_by("p", "parent").alias("sibling"))
    timed = n.where("created_at is not null").select("summary_id", F.lag("told").over(own.orderBy("created_at", "summary_id")).alias("earlier"))
    every = n.select("summary_id").join(placed, "summary_id", "left").join(lined, "summary_id", "left").join(timed, "summary_id", "left")
    via = F.when(F.col("in_context").isNotNull(), "context").when(F.col("sibling").isNotNull(), "siblings").when(F.col("earlier").isNotNull(), "time")
    return every.select("summary_id", F.coalesce("in_context", "sibling", "earlier").alias("previous"), via.alias("via"))


def positions(damaged: DataFrame, context: DataFrame) -> DataFrame:
    """damaged with position, from 1 in each conversation: leaves in context by ordinal, other leaves, then condensed ones from the lowest depth on, by time and id."""
    at = context.groupBy("summary_id").agg(F.min("ordinal").alias("at"))
    lined = damaged.join(at, "summary_id", "left")
    leaf = F.col("depth") == 0
    group = F.when(leaf & F.col("at").isNotNull(), 0).when(leaf, 1).otherwise(2)
    w = Window.partitionBy("conversation_id").orderBy(group, F.when(group == 0, F.col("at")), "depth", "created_at", "summary_id")
    return lined.withColumn("position", F.row_number().over(w)).drop("at")


def repair_texts(nodes: DataFrame, edges: DataFrame, links: DataFrame, messages: DataFrame, context: DataFrame, rewrite: Rewrite, uses_previous: bool = True) -> DataFrame:
    """(conversation_id, summary_id, depth, damage, status, reason, content, token_count) of every damaged summary, rebuilt from what it was made from.

    rewrite (source text, text of the previous summary or null, depth) gives the new text. Leaves are rebuilt from messages, condensed summaries
    from their sources, which are read as rebuilt by then if they come before in the order of `positions`. A round rebuilds all summaries, of all conversations, whose damaged sources (and
    damaged previous one, if uses_previous) before them in that order are done; so there are as many rounds as the longest
    chain of these, without previous texts as many as depths. status: repaired; unchanged: the text was right; skipped: the reason says
    why (content and token_count are null then). A round's results are written, so a lost executor costs one round.
    """
    nodes = nodes.withColumns({"depth": F.coalesce("depth", F.lit(0)).cast("int")})
    found = nodes.withColumn("damage", damage("content")).where("damage is not null")
    hit = kept(positions(found.select("conversation_id", "summary_id", "depth", "created_at", "content", "damage"), context))
    ids = hit.select("conversation_id").distinct()
    nodes = nodes.join(ids, "conversation_id", "left_semi")
    place = hit.select(F.col("summary_id").alias("needs"), F.col("position").alias("before"))
    before = previous_summaries(nodes, edges, context).where("previous is not null").select("summary_id", "previous") if uses_previous else None
    asked = edges.select("summary_id", F.col("source_summary_id").alias("needs"))
    asked = asked if before is None else asked.union(before)
    waits = kept(asked.join(hit.select("summary_id", "position"), "summary_id").join(place, "needs").where("before < position").select("summary_id", "needs").distinct())
    hit = hit.join(before, "summary_id", "left") if uses_previous else hit.withColumn("previous", F.lit(None).cast("string"))

    leaves = hit.where("depth = 0").select("summary_id").join(links, "summary_id").join(messages.select("message_id", "content", "created_at"), "message_id")
    when = F.concat(F.lit("["), F.coalesce(stamp("created_at"), F.lit("unknown")), F.lit("]"))
    leaf_sources = kept(leaves.groupBy("summary_id").agg(source_text(when).alias("source"), F.count("*").alias("n")))
    span = F.concat(F.lit("["), stamp("since"), F.lit(" - "), stamp("until"), F.lit("]"))
    columns = ["conversation_id", "summary_id", "depth", "damage", "status", "reason", "content", "token_count", "position"]
    text = lambda: F.when(F.col("done_at") < F.col("position"), F.col("new")).otherwise(F.col("content"))  # noqa: E731  (what is rebuilt later in the order is read as it was)
    done, open_ = None, kept(hit.select("conversation_id", "summary_id", "depth", "damage", "content", "previous", "position"))
    while not open_.isEmpty():
        ready = open_.join(waits.join(open_.select(F.col("summary_id").alias("needs")), "needs", "left_semi"), "summary_id", "left_anti")
        now = nodes.select("summary_id", "content", F.coalesce("earliest_at", "created_at").alias("since"), F.coalesce("latest_at", "created_at").alias("until"))
        new = done.where("status = 'repaired'") if done is not None else hit.where("false")
        now = now.join(new.select("summary_id", F.col("content").alias("new"), F.col("position").alias("done_at")), "summary_id", "left")
        made_of = ready.where("depth > 0").select("summary_id", "position").join(edges, "summary_id").join(now.withColumnRenamed("summary_id", "source_summary_id"), "source_summary_id").withColumn("content", stripped(text()))
        block = F.concat(F.when(F.col("since").isNotNull() & F.col("until").isNotNull(), F.concat(span, F.lit("\n"))).otherwise(""), F.col("content"))
        texts = F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("ordinal", block.alias("t")))))
        condensed = made_of.groupBy("summary_id").agg(F.array_join(F.transform(texts, lambda r: r["t"]), "\n\n").alias("source"), F.count("*").alias("n"))
        earlier = ready.select("previous", "position", F.col("summary_id").alias("of")).join(now.withColumnRenamed("summary_id", "previous"), "previous").select(F.col("of").alias("summary_id"), stripped(text()).alias("told"))
        rows = ready.join(leaf_sources.unionByName(condensed), "summary_id", "left").join(earlier, "summary_id", "left")
        rows = rows.withColumn("new", stripped(rewrite(F.col("source"), F.col("told"), F.col("depth"))))
        why = (
            F.when(F.col("n").isNull(), F.when(F.col("depth") == 0, "no messages linked to summary").otherwise("no child summaries linked to summary"))
            .when(stripped("source") == "", F.when(F.col("depth") == 0, "source text resolved empty").otherwise("child summaries resolved empty"))
            .when(F.col("new") == "", "summarizer returned empty output").when(damage("new").isNotNull(), "rewritten content still contains a doctor marker")
        )
        rows = rows.withColumn("reason", why).withColumn("status", F.when(F.col("reason").isNotNull(), "skipped").when(F.col("new") == stripped("content"), "unchanged").otherwise("repaired"))
        out = F.when(F.col("status") != "skipped", F.when(F.col("status") == "unchanged", F.col("content")).otherwise(F.col("new")))
        rows = kept(rows.withColumn("content", out).withColumn("token_count", estimate_tokens("content")).select(*columns))
        done = rows if done is None else done.unionByName(rows)
        open_ = kept(open_.join(rows.select("summary_id"), "summary_id", "left_anti"))
    if done is None:
        return open_.select("conversation_id", "summary_id", "depth", "damage", F.lit("").alias("status"), F.lit("").alias("reason"), "content", F.lit(0).cast("long").alias("token_count"))
    return done.drop("position")


def with_repairs(nodes: DataFrame, repairs: DataFrame) -> DataFrame:
    """nodes with the texts and token counts of what was repaired."""
    new = repairs.where("status = 'repaired'").select("summary_id", F.col("content").alias("_content"), F.col("token_count").alias("_tokens"))
    return nodes.join(new, "summary_id", "left").withColumns({"content": F.coalesce("_content", "content"), "token_count": F.coalesce("_tokens", "token_count")}).select(*nodes.columns)


def repair_plan(conversations: DataFrame, messages: DataFrame, nodes: DataFrame, edges: DataFrame, links: DataFrame, context: DataFrame) -> DataFrame:
    """(conversation_id, check, suggestion): what to do about every finding of every check, of all conversations.

    context (conversation_id, ordinal, item_type, ref), messages (conversation_id, message_id, seq), nodes (conversation_id, summary_id, depth).
    Ordinals and seqs must run from 0 without gaps or repeats; rows without a conversation_id aren't checked. Each check is an anti-join
    or an aggregate that shrinks before it is shuffled; only a repeated reference brings its ordinals together, as its suggestion lists them.
    """
    context, messages, nodes = (df.where("conversation_id is not null") for df in (context, messages, nodes))
    known = messages.select(F.lit("message").alias("item_type"), F.col("message_id").cast("string").alias("ref")).union(nodes.select(F.lit("summary"), "summary_id")).distinct()
    every = context.select("conversation_id").union(messages.select("conversation_id")).union(nodes.select("conversation_id")).distinct()
    gaps = lambda df, c: df.groupBy("conversation_id").agg(F.count("*").alias("n"), F.countDistinct(c).alias("kinds"), F.min(c).alias("first"), F.max(c).alias("last")).where("n <> kinds or first <> 0 or last <> n - 1")
    repeated = context.where("ref is not null").groupBy("conversation_id", "item_type", "ref").agg(F.array_sort(F.collect_list("ordinal")).alias("at")).where("size(at) > 1")
    rest = F.array_join(F.transform(F.slice("at", F.lit(2), F.size("at")), lambda o: o.cast("string")), ", ")
    leaf = F.coalesce("depth", F.lit(0)) == 0
    bare = nodes.where(leaf).join(links.select("summary_id").distinct(), "summary_id", "left_anti").unionByName(nodes.where(~leaf).join(edges.select("summary_id").distinct(), "summary_id", "left_anti"))
    lone = orphans(nodes, edges, context.where("item_type = 'summary'").select(F.col("ref").alias("summary_id")))
    # Names of checks and wording of suggestions.
    found = [
        ("conversation_exists", every.join(conversations.select("conversation_id"), "conversation_id", "left_anti"), F.format_string("Create or restore conversation %d in the conversations table", "conversation_id")),
        ("context_items_contiguous", gaps(context, "ordinal"), F.lit("Resequence context items to fix ordinal gaps")),
        ("context_items_valid_refs", context.join(known, ["item_type", "ref"], "left_anti"), F.format_string("Remove context item at ordinal %d referencing missing %s %s", "ordinal", "item_type", "ref")),
        ("summaries_have_lineage", bare, F.concat(F.lit("Add missing lineage for "), F.when(leaf, "leaf").otherwise("condensed"), F.lit(" summary "), "summary_id", F.when(leaf, " (link to source messages via summary_messages)").otherwise(" (link to parent summaries via summary_parents)"))),
        ("no_orphan_summaries", lone, F.concat(F.lit("Remove orphaned summary "), "summary_id", F.lit(" from summaries table"))),
        ("message_seq_contiguous", gaps(messages, "seq"), F.lit("Resequence message seq values to eliminate gaps (renumber starting from 0)")),
        ("no_duplicate_context_refs", repeated, F.concat(F.lit("Deduplicate "), "item_type", F.lit(" "), "ref", F.lit(": keep ordinal "), F.element_at("at", 1).cast("string"), F.lit(", remove ordinals "), rest)),
    ]
    rows = [df.select("conversation_id", F.lit(name).alias("check"), text.alias("suggestion")) for name, df, text in found]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
