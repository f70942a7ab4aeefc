"""The corpus pipeline: toxicity, language, near duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents. Null texts
count as empty; a stage that changes texts keeps n_chars in step. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.llm import language, near, packing, substrings, toxicity
from recall_spark.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("toxicity < 0.5").select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit no language go: null, without a letter, or cheaper to write down letter by letter than in phrases of any language. Without labelled text all stay."""
    return language.languages(docs.select(*COLUMNS)).where("coalesce(lang_fits, true)").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the least doc_id (nulls last) stays; of rows that repeat a doc_id and text, one."""
    docs = docs.select(*COLUMNS)
    key, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text")
    groups = near.similar_groups(docs.select("doc_id", "text"))
    first = groups.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("key"), "mark")).alias("x")).select("x.*")
    return docs.withColumns({"key": key, "mark": mark}).join(first, ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 50 bytes that a document with a smaller doc_id has go; what is left of a character that was cut goes too."""
    left = substrings.without_repeats(docs.select(*COLUMNS))
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, filled to the sources' shares."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_duplicates", keep_one_of_each_group), ("repeated_substrings", cut_repeats), ("packing", pack)]

#: The models, suffix arrays and tokenizer have no SQL form; tests hold operators and stages against brute-force versions or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
