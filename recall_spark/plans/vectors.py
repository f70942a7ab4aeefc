"""Registered queries on vectors: every row whose id is divisible by 50 against all rows, with SQL where the search is exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from recall_spark.functions.text import band
from recall_spark.functions.text import cosine_from_l2
from recall_spark.operators import vectors as X
from recall_spark.plans.queries import query
from recall_spark.sources import views as V

#: The given vectors have hardly any clusters, so a recall of 0.9 takes most cells.
CELLS, PROBES, K = 32, 24, 10


def visible_vectors(spark, d):
    """Vectors of visible leaves of more than twenty tokens and two days: filters go before the search."""
    s = V.summaries(spark, d).where("suppressed_at is null and kind = 'leaf' and token_count > 20 and created_at < timestamp'2024-01-03 00:00:00'")
    return V.read(spark, d, "embeddings").select("vec_id", "embedding").join(s.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


def asked(spark, d):
    return V.read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def found(spark, d, probes):
    v = V.read(spark, d, "embeddings").select("vec_id", "embedding")
    centres = X.fit_centres(v, CELLS)
    return X.search(X.in_cells(visible_vectors(spark, d), "embedding", centres), asked(spark, d), centres, K, probes)


_EXACT = """, v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM summaries WHERE suppressed_at IS NULL AND token_count > 20 AND created_at < TIMESTAMP '2024-01-03')),
 q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
 pairs AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 6) AS distance FROM v, q),
 nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)"""


@query("a3_semantic_search", "summaries", _EXACT + """ SELECT query_id, vec_id, distance, rank, CASE WHEN c >= 0.65 THEN 'high' WHEN c >= 0.5 THEN 'medium' WHEN c >= 0.35 THEN 'low' ELSE 'noise' END AS band
 FROM (SELECT *, round(greatest(-1.0, least(1.0, 1.0 - distance * distance / 2.0)), 6) AS c FROM nn WHERE rank <= 10)""")
def _(spark, d):
    return found(spark, d, None).withColumn("band", band(F.round(cosine_from_l2(F.col("distance")), 6)))


@query("a3_semantic_search_probed")
def _(spark, d):
    return found(spark, d, PROBES)
