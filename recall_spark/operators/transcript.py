"""Tool calls and their results in transcripts: pairing inside spans, repair, and calls whose result is gone.

A transcript is a table (session, at, kind, calls, call_id, failed): kind is assistant, result or other, calls are an
assistant's call ids in order, call_id is a result's. A span runs from an assistant to the next one. `at` orders a session
and is unique in it. Finding spans sorts a session in one task; everything else is joined and counted by (session, span, id).

Nulls: results without a call_id are orphans, null calls are none, a null failed is false, rows of unknown kind count as other.
Sessions without an id stay apart from all others and lose their results. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spans(rows: DataFrame) -> DataFrame:
    """rows with span: how many assistants the session has had, this one included."""
    w = Window.partitionBy("session").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("span", F.count(F.when(F.col("kind") == "assistant", 1)).over(w))


def asked(lined: DataFrame) -> DataFrame:
    """(session, span, call_id, place, repeats, wins) of every call of assistants that didn't fail; the first span that asks an id wins it."""
    own = lined.where("kind = 'assistant' and not coalesce(failed, false)").select("session", "span", F.posexplode("calls").alias("place", "call_id")).where("call_id <> ''")
    own = own.groupBy("session", "span", "call_id").agg(F.min("place").alias("place"), (F.count("*") - 1).alias("repeats"))
    first = own.groupBy("session", "call_id").agg(F.min("span").alias("first"))
    return own.join(first, ["session", "call_id"]).select("session", "span", "call_id", "place", "repeats", (F.col("span") == F.col("first")).alias("wins"))


def pair_in_spans(rows: DataFrame) -> DataFrame:
    """(session, called_at, call_id, answered_at): each call and the first result with its id in its span, if there is one."""
    lined = spans(rows)
    heads = lined.where("kind = 'assistant'").select("session", "span", F.col("at").alias("called_at"))
    results = lined.where("kind = 'result'").groupBy("session", "span", "call_id").agg(F.min("at").alias("answered_at"))
    return asked(lined).join(heads, ["session", "span"]).join(results, ["session", "span", "call_id"], "left").select("session", "called_at", "call_id", "answered_at")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired rows (session, position, at, kind, call_id, made), counters by session).

    Results stand right behind the assistant that asked for them, in the order of its calls, then what else the span
    holds. A call without a result gets a made one (at is null). An id has one result in a session, that of the first span that asks it: later
    ones are duplicates, as are later calls' missing ones. Results that nothing in their span asks for are orphans and go.
    moved counts spans whose results were brought forward past other rows, or stood among them.
    """
    lined = spans(rows)
    calls = asked(lined)
    key = ["session", "span", "call_id"]
    results = lined.where("kind = 'result'").select(*key, "at").join(calls, key, "left")
    matched = results.where("place is not null")
    found = matched.where("wins").groupBy(*key, "place").agg(F.min("at").alias("at"))
    answered = calls.where("wins").join(found.select(*key, "at"), key, "left")
    one = lambda part, place: [F.lit(part).alias("part"), place.cast("long").alias("place")]
    rest = lined.where("kind <> 'result'")
    turns = Window.partitionBy("session", "span").orderBy("at")
    rest = rest.withColumn("n", F.row_number().over(turns)).select("session", "span", F.when(F.col("kind") == "assistant", 0).otherwise(2).alias("part"), F.col("n").cast("long").alias("place"), "at", "kind", F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("made"))
    kept = answered.select("session", "span", *one(1, F.col("place")), "at", F.lit("result").alias("kind"), "call_id", F.col("at").isNull().alias("made"))
    order = Window.partitionBy("session").orderBy("span", "part", "place", "call_id")
    out = rest.union(kept).select("session", (F.row_number().over(order) - 1).cast("long").alias("position"), "at", "kind", "call_id", "made")
    zero = F.lit(0).cast("long")
    mixed = found.select("session", "span").distinct().join(lined.where("kind not in ('result', 'assistant')").select("session", "span").distinct(), ["session", "span"], "left_semi")
    parts = [
        answered.select("session", F.col("at").isNull().cast("long").alias("made"), F.col("repeats").alias("duplicates"), zero.alias("orphans"), zero.alias("moved")),
        calls.where("not wins").select("session", zero, F.col("repeats") + 1, zero, zero),
        matched.where("not wins").select("session", zero, F.lit(1).cast("long"), zero, zero),
        results.where("place is null").select("session", zero, zero, F.lit(1).cast("long"), zero),
        mixed.select("session", zero, zero, zero, F.lit(1).cast("long")),
        lined.select("session", zero, zero, zero, zero).distinct(),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return out, every.groupBy("session").agg(*[F.sum(c).alias(c) for c in ("made", "duplicates", "orphans", "moved")])


def drop_stale_calls(calls: DataFrame, results: DataFrame, boundary: int) -> DataFrame:
    """calls (session, at, call_id) that stay, given all results (session, at, call_id, selected).

    A call stays with a selected result behind it. Without one it goes before the boundary, and beyond it if any result of its id exists.
    """
    by_id = results.groupBy("session", "call_id").agg(F.max(F.when(F.col("selected"), F.col("at"))).alias("last"))
    lined = calls.join(by_id.withColumn("any", F.lit(True)), ["session", "call_id"], "left")
    stays = F.coalesce(F.col("last") > F.col("at"), F.lit(False)) | ((F.col("at") >= boundary) & F.col("any").isNull()) | (F.coalesce("call_id", F.lit("")) == "")
    return lined.where(stays).select(*calls.columns)
