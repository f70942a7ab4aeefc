"""Nearest vectors over an index of cells, for many queries and with filters, approximate or exact.

Centres are fitted by k-means on a bounded sample (SAMPLE vectors, the least by hash of their ids); every vector is indexed, in
the cell of its nearest centre. A query looks into the `probes` cells whose centres are nearest, or into all, which is exact.
Cells and the queries of a cell are cut into blocks, so a task holds BLOCK vectors and BLOCK queries at most, however many
fall into one cell or ask for it; blocks meet in an equi-join by (cell, block, block), and each sends its k best of a query on.

Filters go before: search whatever part of the index has passed them, so none of the k is lost to a filter. Vectors that
are null or of another length than the centres are left out; equal distances go by id. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, ROUNDS, BLOCK = 4096, 10, 8192


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k centres nearest to each row."""
    d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def fit_centres(vectors: DataFrame, cells: int, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """At most `cells` centres of (key, column), by k-means over a sample of at most SAMPLE vectors."""
    rows = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).select(column).limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = _matrix(rows.column(0).combine_chunks())
    centres = x[np.random.default_rng(0).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(ROUNDS):
        own = _nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def in_cells(rows: DataFrame, column: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """rows with cell, once for each of the `probes` nearest cells; centres are of a bounded size, so tasks get them whole."""
    schema = rows.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _nearest(_matrix(batch.column(column)), centres, probes)
                again = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(again) for c in batch.schema.names), pa.array(cells.ravel().astype(np.int32))], [*batch.schema.names, "cell"])

    right = F.col(column).isNotNull() & (F.size(column) == (centres.shape[1] if centres.size else -1))
    return rows.where(right).mapInArrow(run, schema)


def _best(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not vectors.num_rows or not queries.num_rows:
            return empty
        v, q = _matrix(vectors.column("embedding").combine_chunks()), _matrix(queries.column("q").combine_chunks())
        ids = vectors.column("vec_id").to_numpy()
        squares, out = (v**2).sum(1), []
        for name, x in zip(queries.column("query_id").to_pylist(), q, strict=True):
            rough = squares - 2 * v @ x
            near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 1e-4) if len(rough) > k else np.arange(len(rough))
            exact = np.round(np.sqrt(((v[near] - x) ** 2).sum(1)), 6)
            order = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(order), name), ids[near][order], exact[order]))
        return pa.table({"query_id": pa.array(np.concatenate([o[0] for o in out]), pa.int64()), "vec_id": pa.array(np.concatenate([o[1] for o in out]), pa.int64()), "distance": pa.array(np.concatenate([o[2] for o in out]), pa.float64())})

    return run


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest by L2 of an index (vec_id, embedding, cell) for each of queries (query_id, q).

    probes: cells that a query looks into; None is all of them, which is exact.
    """
    spark = index.sparkSession
    if not centres.size:
        return spark.createDataFrame([], "query_id long, vec_id long, distance double, rank long")
    asked = in_cells(queries.select(F.col("query_id").cast("long").alias("query_id"), "q"), "q", centres, len(centres) if probes is None else min(probes, len(centres)))
    own = index.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "cell")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(name))
    sizes = blocks(own, "nv").join(blocks(asked, "nq"), "cell")  # a row for each cell: as many as there are centres
    sizes = F.broadcast(sizes)
    left = own.join(sizes, "cell").withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("nv"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    right = asked.join(sizes, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq"))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)))
    key = ["cell", "vb", "qb"]
    found = left.select(*key, "vec_id", "embedding").groupBy(*key).cogroup(right.select(*key, "query_id", "q").groupBy(*key)).applyInArrow(_best(k), "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
