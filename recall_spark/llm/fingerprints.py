"""Document fingerprints: SimHash in DataFrame operations, and permuted block tables to search them.

Every word of a text, in lower case, votes on each of 64 bits by its XXH64 hash, with its length (at most `HEAVIEST`)
as weight; a bit is 1 if more than half of the weight says so. Votes are summed two to a long, so that a
row of words needs 32 additions. Texts without words have fingerprint zero.

All fingerprints within a Hamming radius are found by permuted block tables: a fingerprint stands in a table for each choice of
blocks that must agree, and pairs that agree in several tables are met in the first of these.

Null is the empty text. Rows that repeat a doc_id and its text give a row each; a doc_id that repeats with other texts
has, as a next document, its least start and least fingerprint. A null doc_id is the last of the order. Columns other than doc_id and
text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

HEAVIEST, RADIUS = 12, 3
_GAPS = r"[\x20\x09-\x0D]+"
_LOW = (1 << 32) - 1


def simhash(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp): fingerprints of a string column; texts without words are absent. Rows that share their keys vote together."""
    words = texts.select(*keys, F.explode(F.split(F.lower(text), _GAPS)).alias("w"))
    weighed = words.select(*keys, F.xxhash64("w").alias("_h"), F.least(F.length("w"), F.lit(HEAVIEST)).cast("long").alias("_n"))
    pair = (1 << 32) | 1
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(pair)) * F.col("_n")).alias(f"v{i}") for i in range(32)]
    votes = weighed.groupBy(*keys).agg(F.sum("_n").alias("n"), *sums).where("n > 0")

    def bit(i: int) -> Column:
        got = F.col(f"v{i % 32}")
        ones = F.shiftrightunsigned(got, 32) if i >= 32 else got.bitwiseAND(F.lit(_LOW))
        return F.when(ones * 2 > F.col("n"), F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    fp = bit(0)
    for i in range(1, 64):
        fp = fp.bitwiseOR(bit(i))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: str, b: str) -> Column:
    """Share of bits in which two fingerprints agree."""
    return 1.0 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def hexed(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of blocks that must agree within radius; a mask's bits are its permutation's head."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [m - (1 << 64) * (m >> 63) for m in (sum(c) for c in combinations(parts, blocks - radius))]


def block_tables(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fps with columns t and key: one row for each mask."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks)])
    return fps.select("*", F.explode(tables).alias("_x")).select("*", F.col("_x.t").alias("t"), F.col("fp").bitwiseAND(F.col("_x.m")).alias("key")).drop("_x")


def within(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(query_fp, fp, distance) of all different fingerprints within radius of each queried one, by block tables.

    Both sides are tables of distinct `fp` longs; membership of documents is a join on fp away, so copies
    never multiply here.
    """
    masks = block_masks(radius, blocks or radius + 3)
    left = block_tables(queries.select(F.col("fp")).distinct(), masks).select(F.col("fp").alias("query_fp"), "t", "key")
    right = block_tables(fps.select("fp").distinct(), masks)
    apart = F.col("query_fp").bitwiseXOR(F.col("fp"))
    distance = F.bit_count(apart)
    earlier = F.lit(False)
    for i, m in enumerate(masks[:-1]):
        earlier = earlier | ((F.col("t") > i) & (apart.bitwiseAND(F.lit(m).cast("long")) == 0))
    return left.join(right, ["t", "key"]).where((distance <= radius) & ~earlier).select("query_fp", "fp", distance.alias("distance"))


def following(ids: DataFrame) -> DataFrame:
    """ids (doc_id, n; doc_id unique) with next_id: the largest smaller doc_id, or for the smallest the largest of all.

    Ranges of doc_id are ordered each on its own; only the first and last id of each range are ordered at once.
    """
    part = saved(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    inner = part.withColumn("next_id", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    ends = part.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    all_ends = Window.orderBy("low")
    joins = ends.select("part", F.coalesce(F.lag("high").over(all_ends), F.last("high").over(all_ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    return inner.join(F.broadcast(joins), "part").select("doc_id", "n", F.coalesce("next_id", "before").alias("next_id"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within) of documents (doc_id, text).

    A text's latter half is edited: the start of the next document (descending doc_id; after the last the first) takes
    its place. near_edited and near_next are shares of equal bits; n_within counts the rows whose fingerprint is within RADIUS bits,
    the row itself among them.
    """
    least = F.lit(-(1 << 63)).cast("long")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = saved(following(texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))))
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.floor(F.col("n") / 2).cast("int").alias("k"))
    heads = texts.join(asked, "doc_id").select(F.col("for_id").alias("doc_id"), F.expr("left(text, k)").alias("head")).groupBy("doc_id").agg(F.min("head").alias("head"))
    half = "cast(floor(length(text) / 2) as int)"
    both = texts.join(heads, "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "text", F.expr(f"concat(left(text, length(text) - {half}), left(head, {half}))").alias("edited"))
    rows = both.select("doc_id", "h", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    voters = both.select("doc_id", "h", F.posexplode(F.array("text", "edited")).alias("which", "t"))
    fps = simhash(voters, ["doc_id", "h", "which"], "t").withColumnRenamed("h", "text_hash").groupBy("doc_id", "text_hash").agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    zero = F.lit(0).cast("long")
    rows = rows.withColumnRenamed("h", "text_hash").groupBy("doc_id", "text_hash").agg(F.first("n_chars").alias("n_chars"), F.first("edited_sha256").alias("edited_sha256"), F.count("*").alias("rows"))
    found = saved(rows.join(fps, ["doc_id", "text_hash"], "left").withColumns({c: F.coalesce(c, zero) for c in ("fp", "edited_fp")}))
    after = found.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    nodes = saved(found.groupBy("fp").agg(F.sum("rows").alias("rows")))
    near = within(nodes, nodes).join(nodes, "fp").groupBy(F.col("query_fp").alias("fp")).agg(F.sum("rows").alias("n_within"))
    lined = found.join(order.join(after, "next_id").select("doc_id", "next_fp"), "doc_id").join(near, "fp")
    every = texts.select("doc_id", F.xxhash64("text").alias("text_hash")).join(lined, ["doc_id", "text_hash"])
    return every.select(
        F.nullif("doc_id", least).alias("doc_id"), "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_within",
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLES: dict[str, str] = {}
