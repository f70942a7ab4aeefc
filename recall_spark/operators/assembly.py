"""Assembling a context within a token budget, for all conversations at once.

The newest items always stay. Of the rest all stay if they fit; else, with a prompt, the most relevant go in first and an
item that doesn't fit is passed over; without a prompt the newest stay up to the first that doesn't fit.

What fits depends on all that was taken before, so a conversation is folded in order in one task, which streams its sorted
rows and holds none. Nulls: a null token count is 0, null texts score 0, a conversation without a prompt has none. Ties of
relevance go to the newer item. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a term is, and the least length of one.
TERM, LEAST_TERM = "[a-z0-9]+", 2


def terms(text: Column | str) -> Column:
    """Terms of a text, in order, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)), lambda t: F.length(t) >= LEAST_TERM)


def relevance(text: Column | str, asked: Column | str) -> Column:
    """Share of a text's terms that are asked."""
    own = terms(text)
    hits = F.size(F.filter(own, lambda t: F.array_contains(asked, t)))
    return F.round(F.when(F.size(own) > 0, hits / F.size(own)).otherwise(0.0), 6)


def assemble(items: DataFrame, prompts: DataFrame, tail: int, budget: int) -> DataFrame:
    """Items (conversation_id, ordinal, token_count, content) that make the context, with mode: full-fit, prompt-aware or chronological.

    prompts (conversation_id, prompt) has at most one row a conversation.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("ordinal"))
    tokens = F.coalesce("token_count", F.lit(0)).cast("long")
    ranked = items.select("conversation_id", "ordinal", tokens.alias("token_count"), "content", F.row_number().over(newest).alias("rn"))
    sums = ranked.groupBy("conversation_id").agg(F.sum(F.when(F.col("rn") <= tail, F.col("token_count")).otherwise(0)).alias("in_tail"), F.sum(F.when(F.col("rn") > tail, F.col("token_count")).otherwise(0)).alias("total"))
    room = F.greatest(F.lit(0), budget - F.col("in_tail"))
    plan = sums.join(prompts.select("conversation_id", F.array_distinct(terms("prompt")).alias("asked")), "conversation_id", "left")
    mode = F.when(F.col("total") <= room, "full-fit").when(F.size("asked") > 0, "prompt-aware").otherwise("chronological")
    plan = plan.select("conversation_id", "asked", room.cast("long").alias("room"), mode.alias("mode"))
    scored = ranked.join(plan, "conversation_id").withColumn("score", F.when((F.col("mode") == "prompt-aware") & (F.col("rn") > tail), relevance("content", "asked")).otherwise(0.0))
    lined = scored.withColumn("old", F.col("rn") > tail).select("conversation_id", "ordinal", "token_count", "old", "room", "mode", "score")
    schema = lined.select("conversation_id", "ordinal", "token_count", "mode").schema

    def run(batches):
        import pyarrow as pa

        now, used, closed = object(), 0, False
        for batch in batches:
            keep = []
            for conv, t, old, room, mode in zip(*[batch.column(c).to_pylist() for c in ("conversation_id", "token_count", "old", "room", "mode")], strict=True):
                if conv != now:
                    now, used, closed = conv, 0, False
                fits = not closed and used + t <= room
                keep.append(not old or fits)
                if old and fits:
                    used += t
                elif old:
                    closed = mode != "prompt-aware"
            yield batch.filter(pa.array(keep, pa.bool_())).select(schema.names)

    return lined.repartition("conversation_id").sortWithinPartitions("conversation_id", F.desc("score"), F.desc("ordinal")).mapInArrow(run, schema)
