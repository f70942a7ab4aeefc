"""The summary graph: edges run from a node to what it was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.sources.shared import kept


def expand_to_sources(edges: DataFrame, roots: DataFrame, max_depth: int = 50) -> DataFrame:
    """(root, summary_id, depth) of all that roots (root) were made from, at the least depth; cycles end by what was visited.

    A graph deeper than max_depth is refused, as its nodes would be lost.
    """
    return expand_paths(edges.withColumn("ordinal", F.lit(0)), roots, max_depth).select("root", "summary_id", "depth")


def expand_paths(edges: DataFrame, roots: DataFrame, max_depth: int = 50) -> DataFrame:
    """(root, summary_id, depth, path) of all that roots (root) were made from, each once, at its least depth and first path there.

    edges (summary_id, source_summary_id, ordinal); a path is ordinals of four digits with dots between, empty for the root.
    """
    front = kept(roots.select("root", F.col("root").alias("summary_id"), F.lit(0).alias("depth"), F.lit("").alias("path")).distinct())
    seen = front
    steps = edges.select("summary_id", F.col("source_summary_id").alias("next"), F.format_string("%04d", F.col("ordinal").cast("long")).alias("place"))
    for depth in range(1, max_depth + 2):
        step = front.join(steps, "summary_id").select("root", F.col("next").alias("summary_id"), F.when(F.col("path") == "", F.col("place")).otherwise(F.concat_ws(".", "path", "place")).alias("path"))
        step = step.groupBy("root", "summary_id").agg(F.min("path").alias("path")).select("root", "summary_id", F.lit(depth).alias("depth"), "path")
        front = kept(step.join(seen, ["root", "summary_id"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise ValueError(f"the graph goes on below depth {max_depth}")


def manifest(nodes: DataFrame, edges: DataFrame, roots: DataFrame, budget: int, most: int = 10_000, max_depth: int = 50) -> DataFrame:
    """What it costs to go down from roots (root, budget; a null budget is `budget`, at least 1): a row for each visible node under each root.

    nodes (summary_id, token_count, descendant_tokens, source_tokens, created_at, suppressed); null or negative tokens are 0. Nodes below a
    suppressed one are still walked. summaries_only is the node and all below, with_messages its messages too; fits_* say whether
    that is within the root's budget. before is the node before on the path, n_below the number of edges from the node. A root's first
    `most` nodes by depth, path and time are listed, n_nodes says how many there are. Edges with swapped columns walk to what was made from a node.
    """
    asked = roots.groupBy("root").agg(F.greatest(F.coalesce(F.max("budget"), F.lit(budget)), F.lit(1)).alias("budget"))
    walked = kept(expand_paths(edges, asked, max_depth))
    up = F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("path", r"\.[^.]*$", ""))
    named = walked.where("depth > 0").withColumn("up", up).join(walked.select("root", F.col("path").alias("up"), F.col("summary_id").alias("before")), ["root", "up"]).select("root", "summary_id", "before")
    size = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    costs = nodes.where(~F.coalesce("suppressed", F.lit(False))).select("summary_id", (size("token_count") + size("descendant_tokens")).alias("summaries_only"), size("source_tokens").alias("raw"), "created_at")
    costs = costs.join(edges.groupBy("summary_id").agg(F.count("*").alias("n_below")), "summary_id", "left").withColumn("n_below", F.coalesce("n_below", F.lit(0)))
    rows = walked.join(costs, "summary_id").join(named, ["root", "summary_id"], "left").join(asked, "root").withColumn("with_messages", F.col("summaries_only") + F.col("raw"))
    every = Window.partitionBy("root")
    rows = rows.join(rows.groupBy("root").agg(F.count("*").alias("n_nodes")), "root").withColumn("place", F.row_number().over(every.orderBy("depth", "path", "created_at", "summary_id"))).where(F.col("place") <= most)
    fits = lambda c: (F.col(c) <= F.col("budget")).alias(f"fits_{c}")
    return rows.select("root", "summary_id", "before", "depth", "path", "n_below", "summaries_only", "with_messages", fits("summaries_only"), fits("with_messages"), "n_nodes")


def one_hop(edges: DataFrame) -> DataFrame:
    return edges.groupBy("summary_id").agg(F.count("*").alias("n_sources"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def compute_depths(nodes: DataFrame, edges: DataFrame, max_depth: int = 50) -> DataFrame:
    """(summary_id, depth): 1 + the deepest source; of nodes without sources leaves have 0 and condensed ones (kind, if nodes have it) 1, as has what lies on or above a cycle.

    A graph deeper than max_depth is refused.
    """
    bottom = F.when(F.col("kind") == "condensed", 1).otherwise(0) if "kind" in nodes.columns else F.lit(0)
    done = kept(nodes.join(edges, "summary_id", "left_anti").select("summary_id", bottom.alias("depth")))
    waiting = kept(nodes.select("summary_id").join(done, "summary_id", "left_anti"))
    for _ in range(max_depth + 1):
        known = edges.join(waiting, "summary_id").join(done.withColumnsRenamed({"summary_id": "source_summary_id"}), "source_summary_id", "left")
        ready = kept(known.groupBy("summary_id").agg(F.max("depth").alias("d"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0").select("summary_id", (F.col("d") + 1).alias("depth")))
        if ready.isEmpty():
            return done.union(waiting.select("summary_id", F.lit(1).alias("depth")))
        done, waiting = done.union(ready), kept(waiting.join(ready, "summary_id", "left_anti"))
    raise ValueError(f"the graph goes on above depth {max_depth}")


def rollup_tokens(nodes: DataFrame, edges: DataFrame, own: DataFrame, levels: int) -> DataFrame:
    """(summary_id, n_descendants, tokens) of nodes (summary_id, depth): leaves' tokens and descendants summed bottom-up; paths count.

    A node of a depth is worked out from all shallower ones, so its sources may lie on several levels.
    """
    done = kept(nodes.where("depth = 0").join(own, "summary_id", "left").select("summary_id", F.lit(0).cast("long").alias("n_descendants"), F.coalesce("token_count", F.lit(0)).cast("long").alias("tokens")))
    for d in range(1, levels + 1):
        here = edges.join(nodes.where(F.col("depth") == d).select("summary_id"), "summary_id")
        level = here.join(done.withColumnRenamed("summary_id", "source_summary_id"), "source_summary_id").groupBy("summary_id").agg(F.sum(F.col("n_descendants") + 1).alias("n_descendants"), F.sum("tokens").alias("tokens"))
        done = done.union(kept(level))
    return done


def child_status(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Sources of each node, hidden ones apart: none left is all_suppressed."""
    lined = edges.join(hidden.select(F.col("summary_id").alias("source_summary_id"), F.lit(1).alias("h")), "source_summary_id", "left")
    out = lined.groupBy("summary_id").agg(F.count("*").alias("n_sources"), F.count_if(F.col("h") == 1).alias("n_hidden"))
    return out.withColumn("status", F.when(F.col("n_hidden") == F.col("n_sources"), "all_suppressed").when(F.col("n_hidden") > 0, "some_suppressed").otherwise("ok"))
