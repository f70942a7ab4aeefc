"""Packing of one very long conversation."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from recall_spark.operators import windows as W


@pytest.mark.parametrize("plan", [lambda m: W.greedy_pack_folded(m, "conversation_id", "ordinal", "token_count", 100), lambda m: W.plan_leaf_chunks(m, 2, 100)])
def test_long_conversation(spark, plan):
    n = 30_000
    got = plan(spark.range(n + 2).select(F.lit(7).cast("long").alias("conversation_id"), F.col("id").alias("ordinal"), (F.col("id") * 37 % 120).alias("token_count")))
    with contextlib.redirect_stdout(io.StringIO()) as said:
        got.explain()
    assert "collect_list" not in said.getvalue()
    chunk, used, want = 0, 0, {}
    for i in range(n):
        t = i * 37 % 120
        if used and used + t > 100:
            chunk, used = chunk + 1, 0
        used += t
        want[i] = chunk
    found = {r.ordinal: r.chunk for r in got.collect()}
    assert {i: found[i] for i in range(n)} == want
