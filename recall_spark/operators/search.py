"""Keyword, pattern and vector search for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.text import band, cosine_from_l2, snippet, words

# BM25's parameters, the rank constant of reciprocal rank fusion, decay per hour of age.
K1, B, RRF, DECAY = 1.2, 0.75, 60, 0.001


def parse_query(text: str) -> list[str]:
    """Terms of a query: quoted phrases stay whole, all must match; nothing to search gives no terms."""
    import re

    parts = re.findall(r'"([^"]*)"|(\S+)', text)
    return [t for t in dict.fromkeys((a or b).strip().lower() for a, b in parts) if re.search(r"\w", t)]


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, rank, score) of the k best documents that have all terms of a query (query_id, terms).

    Makes a posting table for this one call; for several searches make it once (postings.index_words).
    """
    from recall_spark.operators import postings as N

    return N.best(N.matches(N.index_words(docs, key, text, places=False), queries), key, k)


def phrase_search(docs: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Documents in which the phrase's words stand side by side."""
    padded = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return docs.where(F.contains(padded, F.lit(f" {' '.join(phrase.lower().split())} "))).select(key)


def like_terms(terms: list[str]) -> list[str]:
    """Terms in lower case, without punctuation at their edges, each once, in order; nothing is left of mere punctuation."""
    import re

    return list(dict.fromkeys(t for t in (re.sub(r"^[\W_]+|[\W_]+$", "", t.lower()) for t in terms) if t))


def like_search(docs: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    """Documents that contain all terms, in any case, with a snippet, newest key first; without a term none."""
    terms, hit = like_terms(terms), F.lit(True)
    if not terms:
        return docs.where(F.lit(False)).select(key, F.lit("").alias("snippet"))
    for t in terms:
        hit = hit & F.contains(F.lower(text), F.lit(t))
    return docs.where(hit).select(key, snippet(text, terms).alias("snippet")).orderBy(F.desc(key)).limit(k)


def repeats_a_repetition(pattern: str) -> bool:
    """Whether a group that is repeated without bound holds such a repetition at any depth, as in (a+)+, ((a+))+ or (a{1,})*."""
    import re

    bare = re.sub(r"\\.", "x", pattern)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "x", bare)
    again, holds, last = re.compile(r"[+*]|\{\d*,\d*\}"), [False], False
    for i, c in enumerate(bare):
        if c == "(":
            holds.append(False)
        elif c == ")" and len(holds) > 1:
            last = holds.pop()
            if last and again.match(bare, i + 1):
                return True
            holds[-1] |= last
        elif again.match(bare, i):
            holds[-1] = True
    return False


def regex_search(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """All documents that a pattern finds, with its first match; long patterns and nested quantifiers are refused."""
    if len(pattern) > 500 or repeats_a_repetition(pattern):
        raise ValueError("the pattern is too long or repeats a repetition")
    return docs.where(F.col(text).rlike(pattern)).select(key, F.regexp_extract(text, pattern, 0).alias("found"))


def tf_score(docs: DataFrame, key: str, text: str, prompt: str) -> DataFrame:
    """Sum over the prompt's different terms of their share of the text's terms."""
    import re

    asked = sorted({t for t in re.findall(r"[a-z0-9]+", prompt.lower()) if len(t) > 1})
    own = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)
    hits = F.size(F.filter("w", lambda t: t.isin(asked)))
    return docs.select(key, own.alias("w")).select(key, F.round(F.when(F.size("w") > 0, hits / F.size("w")).otherwise(0.0), 6).alias("score"))


def order_hits(hits: DataFrame, key: str, mode: str, now: str, k: int) -> DataFrame:
    """The k first hits (key, score, created_at) by recency, relevance or both; rank is minus score, so small is good."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")) / 3600.0
    by = {"recency": F.lit(0.0), "relevance": -F.col("score"), "hybrid": -F.col("score") / (1 + age * DECAY)}[mode]
    return hits.withColumn("order_key", F.round(by, 6)).orderBy("order_key", F.desc("created_at"), key).limit(k)


def with_bands(hits: DataFrame) -> DataFrame:
    return hits.withColumn("cosine", F.round(cosine_from_l2(F.col("distance")), 6)).withColumn("band", band(F.col("cosine")))


def fuse(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, key, rank from 1)."""
    part = lambda r: F.coalesce(1.0 / (RRF + F.col(r) - 1), F.lit(0.0))
    both = a.select("query_id", key, F.col("rank").alias("ra")).join(b.select("query_id", key, F.col("rank").alias("rb")), ["query_id", key], "full")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("ra"), key)
    return both.withColumn("score", F.round(part("ra") + part("rb"), 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pending(s: DataFrame, embedded: DataFrame, low: int, high: int) -> DataFrame:
    """Visible leaves in a token range that aren't embedded."""
    return s.where("suppressed_at is null and kind = 'leaf'").where(F.col("token_count").between(low, high)).join(embedded.select("summary_id"), "summary_id", "left_anti")


def recall_at_k(hits: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Recall at each k and reciprocal rank per query with truth (query_id, key)."""
    size = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    key = next(c for c in truth.columns if c != "query_id")
    found = hits.join(truth, ["query_id", key])
    out = size.join(found, "query_id", "left").groupBy("query_id", "n").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.min("rank").alias("best"))
    return out.select("query_id", *[F.round(F.col(f"h{k}") / F.col("n"), 6).alias(f"recall_{k}") for k in ks], F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("rr"))
