"""Packing of tables that are laid out by source."""

from collections import Counter, defaultdict

import pytest
from recall_spark.llm import packing

SHARES = {"a": 0.5, "b": 0.3, "c": 0.2}


@pytest.mark.parametrize("mixture", [None, {"a": 1.0, "b": 1.0, "c": 2.0}])
def test_source_sorted_table_holds_the_mixture(spark, mixture):
    rows = [(i, "some words of a text " * 20, "a" if i < 500 else "b" if i < 800 else "c") for i in range(1000)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 10), "doc_id long, text string, source string")
    source, size, seen = {i: s for i, _, s in rows}, {}, defaultdict(list)
    windows: dict[int, Counter] = defaultdict(Counter)
    for r in packing.pack(docs, mixture).collect():
        windows[r.sequence_id][source[r.doc_id]] += r.length
        size[r.doc_id] = r.doc_tokens
        seen[r.doc_id].append((r.start, r.length))
    for i, pieces in seen.items():
        assert sum(n for _, n in pieces) == size[i] and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:]))
    assert len(seen) == 1000
    target = SHARES if mixture is None else {"a": 0.25, "b": 0.25, "c": 0.5}
    full = [windows[k] for k in sorted(windows) if sum(windows[k].values()) == packing.SEQUENCE]
    # with the mixture, c has no tokens left after 40 % of all
    for w in full if mixture is None else full[: len(full) // 3]:
        assert all(abs(w[s] / packing.SEQUENCE - x) < 0.06 for s, x in target.items())
