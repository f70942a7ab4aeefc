"""The vector index against brute force."""

import numpy as np
import pytest

from recall_spark.operators import vectors as X
from recall_spark.plans import vectors as P

SCHEMA = "vec_id long, embedding array<float>"


def brute(v, q, k):
    out = []
    for name, x in q:
        d = sorted((round(float(np.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(y, x, strict=True)))), 6), i) for i, y in v)[:k]
        out += [(name, i, dist, r + 1) for r, (dist, i) in enumerate(d)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 7])
def test_exact_search_with_ties_a_hot_cell_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    rng = np.random.default_rng(2)
    v = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(50)]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [])]
    q = [(i, x) for i, x in v if i % 10 == 0]
    vectors = spark.createDataFrame(v + odd, SCHEMA).repartition(4)
    centres = X.fit_centres(vectors.where("size(embedding) = 4"), 6)
    got = X.search(X.in_cells(vectors, "embedding", centres), spark.createDataFrame(q, "query_id long, q array<float>"), centres, 7)
    assert sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in got.collect()) == brute(v, q, 7)


def test_recall_of_probes(spark):
    d = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.vec_id) for r in P.found(spark, d, None).collect()}
    near = {(r.query_id, r.vec_id) for r in P.found(spark, d, P.PROBES).collect()}
    assert exact and len(exact & near) >= 0.9 * len(exact)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    centres = X.fit_centres(none, 4)
    assert X.search(X.in_cells(none, "embedding", centres), spark.createDataFrame([(1, [1.0])], "query_id long, q array<float>"), centres, 3).collect() == []
