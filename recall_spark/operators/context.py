"""Worklists, compaction steps, rendering, file references, cache keys and evaluation reports, for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Markers of summaries without a model (whole, cut), least length of their text in characters, pattern of file ids.
FALLBACK_WHOLE = "[LCM fallback summary — model unavailable; raw source preserved verbatim below]"
FALLBACK_CUT = "[LCM fallback summary — model unavailable; raw source truncated for context management]"
LEAST_FALLBACK, FILE_ID = 256, r"(?i)\bfile_[a-f0-9]{16}\b"


def covered_only_by(links: DataFrame, hidden: DataFrame) -> DataFrame:
    """(conversation_id, ordinal) of links (conversation_id, ordinal, leaf) whose leaves are all in hidden (conversation_id, leaf)."""
    marked = links.join(hidden.select("conversation_id", "leaf", F.lit(True).alias("gone")), ["conversation_id", "leaf"], "left")
    return marked.groupBy("conversation_id", "ordinal").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("gone")).where("gone").drop("gone")


def next_leaf_chunk(chunks: DataFrame) -> DataFrame:
    """The oldest chunk of each conversation; chunks are numbered from 0 in order."""
    return chunks.where("chunk = 0")


def replace_ranges(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items (conversation_id, ordinal, ref) with each range (conversation_id, first, last, summary) as one summary in its place, numbered again from 0.

    Ranges of a conversation don't overlap.
    """
    # ranges are laid among the items by where they start; the last one that started says whether an item is inside
    here = Window.partitionBy("conversation_id").orderBy("ordinal", F.desc("starts")).rowsBetween(Window.unboundedPreceding, 0)
    every = items.select("conversation_id", "ordinal", "ref", F.lit(False).alias("starts"), F.lit(None).cast("long").alias("end")).union(ranges.select("conversation_id", F.col("first").cast("long"), F.lit(None).cast("string"), F.lit(True), F.col("last").cast("long")))
    covered = every.withColumn("end", F.last("end", ignorenulls=True).over(here)).where(~F.col("starts") & (F.col("end").isNull() | (F.col("ordinal") > F.col("end"))))
    after = covered.select("conversation_id", "ordinal", "ref").union(ranges.select("conversation_id", "first", "summary"))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("ordinal")) - 1
    return after.select("conversation_id", place.cast("long").alias("ordinal"), "ref")


def fallback_summary(text: Column | str, target: int) -> Column:
    """The marker of a summary without a model, and the text up to four characters a token; nothing for blank texts."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    most = max(LEAST_FALLBACK, 4 * target)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "").when(F.length(trimmed) <= most, F.concat(F.lit(FALLBACK_WHOLE + "\n"), trimmed)).otherwise(F.concat(F.lit(FALLBACK_CUT + "\n"), F.substring(trimmed, 1, most)))


def render_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(summary_id, rendered) of nodes (summary_id, kind, depth, descendants, content): attributes, source references in order, content."""
    refs = edges.groupBy("summary_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "source_summary_id"))).alias("refs"))  # as many as the fan-out of a node
    lines = F.transform("refs", lambda r: F.concat(F.lit('    <summary_ref id="'), r.source_summary_id, F.lit('" />')))
    parents = F.when((F.col("kind") == "condensed") & (F.size("refs") > 0), F.concat(F.lit("  <parents>\n"), F.array_join(lines, "\n"), F.lit("\n  </parents>\n"))).otherwise("")
    head = F.format_string('<summary id="%s" kind="%s" depth="%d" descendant_count="%d">\n', "summary_id", "kind", "depth", "descendants")
    return nodes.join(refs, "summary_id", "left").select("summary_id", F.concat(head, parents, F.lit("  <content>\n"), F.coalesce("content", F.lit("")), F.lit("\n  </content>\n</summary>")).alias("rendered"))


def file_ids(text: Column | str) -> Column:
    """Ids of files in a text, lower-cased, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(FILE_ID), 0), F.lower))


def latest_bindings(bindings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest of each key's bindings is active; those before it are archived."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return bindings.withColumn("active", (F.row_number().over(last) == 1).cast("int"))


def tighten(lower: list[Column], upper: list[Column]) -> tuple[Column, Column, Column]:
    """The latest lower bound, the earliest upper bound, and whether anything lies between; nulls are no bounds."""
    low, high = F.greatest(*lower), F.least(*upper)
    return low, high, F.coalesce(low < high, F.lit(True))


def cache_misses(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Different requests whose key the cache lacks; nulls in keys are equal."""
    same = requests.alias("r"), cache.select(*key).alias("c")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    return same[0].join(same[1], on, "left_anti").dropDuplicates(key)


def resolve_session_key(target: Column, given: Column, first: Column, default: str) -> Column:
    """The first of target, what is given and the first conversation's key that isn't blank, or the default."""
    blank = F.lit("")
    return F.coalesce(*[F.nullif(F.trim(c), blank) for c in (target, given, first)], F.lit(default))


def recall_lift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stratum, recall_a, recall_b, lift) of queries (query_id, stratum, recall) that both arms ran; without a stratum 'unknown'."""
    both = a.join(b.select("query_id", F.col("recall").alias("other")), "query_id")
    means = both.groupBy(F.coalesce("stratum", F.lit("unknown")).alias("stratum")).agg(F.avg("recall").alias("recall_a"), F.avg("other").alias("recall_b"))
    return means.withColumn("lift", F.col("recall_b") - F.col("recall_a"))


def quality_report(scores: DataFrame, key: str) -> DataFrame:
    """Mean score, scored and failed (null) judgements of each key."""
    return scores.groupBy(key).agg(F.avg("score").alias("mean_score"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("failed"))


def hit_band(cosine: Column, reranked: Column, band) -> tuple[Column, Column]:
    """(band, where it is from) of a best hit: its cosine, else its reranked score; without either no match."""
    value = F.coalesce(cosine, reranked)
    source = F.when(cosine.isNotNull(), "cosine").when(reranked.isNotNull(), "rerank")
    return F.when(value.isNull(), "no-match").otherwise(band(value)), source
