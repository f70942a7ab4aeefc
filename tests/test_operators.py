"""Operators on odd rows: nulls, ties, empty and repeated rows, and rules that the given tables don't reach."""

import json
import re

import pytest
from pyspark.sql import functions as F

from recall_spark.operators import assembly as A
from recall_spark.operators import compaction as K
from recall_spark.operators import payloads as P
from recall_spark.operators import transcript as T
from recall_spark.operators import windows as W

M = "message_id long, conversation_id long, content string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def folded(items, budget, close):
    out, now, chunk, used = [], None, 0, 0
    for k, o, t in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        t = max(t or 0, 0)
        if now is None or k != now[0]:
            now, chunk, used = (k,), 0, 0
        elif used and (used + t > budget or (close and used >= budget)):
            chunk, used = chunk + 1, 0
        used += t
        out.append((k, o, chunk))
    return sorted(out, key=repr)


@pytest.mark.parametrize("close", [False, True])
def test_packing_against_a_fold(spark, close):
    items = [(k, o, [50, None, 90, 90, 0, 0, 100, 0, 300, 0, 10, -5, 100, 0, 100][(o * (k or 3)) % 15]) for k in (None, 1, 2, 7) for o in range(40)]
    df = spark.createDataFrame(items, "k long, o long, t long").repartition(3)
    got = W.greedy_pack(df, "k", "o", "t", 100, close_on_fill=close).select("k", "o", "chunk")
    assert rows(got) == folded(items, 100, close)
    assert rows(W.greedy_pack(df.where("o < 0"), ["k"], "o", "t", 100)) == []


def context(spark, rs):
    """Items (conversation, ordinal, type, depth, tokens)."""
    zero = F.lit(0).cast("long")
    df = spark.createDataFrame([(c, o, t, f"{t[0]}{c}_{o}", d, n) for c, o, t, d, n in rs], "conversation_id long, ordinal long, item_type string, ref string, depth int, token_count long")
    at = F.timestamp_seconds(F.col("ordinal"))
    return df.withColumns({"earliest_at": at, "latest_at": at, "content": F.concat(F.lit("text "), "ref"), "descendants": zero, "descendant_tokens": zero, "source_tokens": F.col("token_count")}).select(*K.ITEM)


def test_chunks_lie_within_islands(spark):
    items = context(spark, [(1, 0, "message", None, 10), (1, 1, "summary", 0, 5), (1, 2, "message", None, 60), (1, 3, "message", None, 60), (1, 4, "summary", 1, 5), (1, 5, "message", None, 500), (1, 6, "message", None, 1), (1, 7, "message", None, 1), (2, 0, "message", None, 5)])
    assert rows(K.leaf_chunks(items, 1, 100).select("conversation_id", "ordinal", "chunk")) == [(1, 0, 0), (1, 2, 1), (1, 3, 2), (1, 5, 3), (1, 6, 4)]


def test_oldest_chunk_of_the_shallowest_depth(spark):
    p = K.Policy(tail=1, condensed_chunk=100, leaf_fanout=3, condensed_fanout=2, condensed_target=20, budget=0)
    leaves = [(1, o, "summary", 0, 40) for o in range(2)] + [(1, 2, "message", None, 1)] + [(1, o, "summary", 0, 10) for o in range(3, 7)]
    deeper = [(1, 7, "summary", 1, 30), (1, 8, "summary", 1, 30), (1, 9, "summary", 1, 90), (1, 10, "message", None, 1)]
    items = context(spark, leaves + deeper)
    got = {(r.depth, r.ordinal, r.eligible) for r in K.condensed_chunks(items, p).collect()}
    assert got == {(0, 0, False), (0, 1, False), (1, 7, True), (1, 8, True)}  # the oldest island of leaves is too small, newer ones don't count
    assert sorted(r.ordinal for r in K.condensation_candidates(items, p).collect()) == [7, 8]
    assert sorted(r.ordinal for r in K.condensation_candidates(items, p, hard=True).collect()) == [0, 1]


def test_compaction_stops_key_by_key(spark):
    p = K.Policy(tail=1, chunk=300, condensed_chunk=1000, leaf_fanout=2, condensed_fanout=2, condensed_target=10, text_target=64, budget=400)
    long = [(1, o, "message", None, 250) for o in range(9)]
    small = [(2, o, "message", None, 10) for o in range(5)]
    empty = [(3, 0, "message", None, None)]
    items = context(spark, long + small + empty).withColumn("token_count", F.coalesce("token_count", F.lit(0)))
    after, nodes, edges = K.compact(items, p)
    by = {r.conversation_id: r.n for r in nodes.groupBy("conversation_id").agg(F.count("*").alias("n")).collect()}
    assert set(by) == {1}  # the others are under the threshold
    assert rows(after.where("conversation_id <> 1").select("conversation_id", "ordinal")) == [(2, o) for o in range(5)] + [(3, 0)]
    kept = after.where("conversation_id = 1")
    assert [r.ordinal for r in kept.orderBy("ordinal").collect()] == list(range(kept.count()))
    assert kept.where("ref = 'm1_8'").count() == 1  # the tail stays
    sources = {r.source_ref for r in edges.collect()}
    assert {f"m1_{o}" for o in range(8)} <= sources | {r.ref for r in kept.collect()}
    top = kept.where("item_type = 'summary'").agg(F.sum("source_tokens")).first()[0]
    assert top + 250 + sum(r.token_count for r in kept.where("item_type = 'message' and ref <> 'm1_8'").collect()) == 9 * 250
    for t in (after, nodes, edges):
        assert t.count() == t.distinct().count()
    assert K.compact(items.limit(0), p)[0].collect() == []


def call(s, at, *calls, failed=None):
    return (s, at, "assistant", list(calls), None, failed)


def result(s, at, call_id):
    return (s, at, "result", None, call_id, None)


SCHEMA = "session long, at long, kind string, calls array<string>, call_id string, failed boolean"


def test_transcript_repair(spark):
    rs = [
        (1, 0, "other", None, None, None), result(1, 1, "a"), call(1, 2, "a", "b"), (1, 3, "other", None, None, None), result(1, 4, "b"), result(1, 5, "a"), result(1, 6, "a"), result(1, 7, "z"), result(1, 8, None),
        call(1, 9, "a", "c"), result(1, 10, "a"), call(1, 11, "d", failed=True), result(1, 12, "d"), call(1, 13), result(1, 14, "c"), call(1, 15, "e", "e"), (2, 0, "other", None, None, None), call(2, 1, "a"),
    ]
    out, counters = T.repair(spark.createDataFrame(rs, SCHEMA).repartition(3))
    got = [(r.session, r.at, r.kind, r.call_id, r.made) for r in sorted(out.collect(), key=lambda r: (r.session, r.position))]
    assert got == [
        (1, 0, "other", None, False), (1, 2, "assistant", None, False), (1, 5, "result", "a", False), (1, 4, "result", "b", False), (1, 3, "other", None, False), (1, 9, "assistant", None, False), (1, None, "result", "c", True),
        (1, 11, "assistant", None, False), (1, 13, "assistant", None, False), (1, 15, "assistant", None, False), (1, None, "result", "e", True), (2, 0, "other", None, False), (2, 1, "assistant", None, False), (2, None, "result", "a", True),
    ]
    assert rows(counters) == [(1, 2, 3, 5, 1), (2, 1, 0, 0, 0)]
    assert rows(T.pair_in_spans(spark.createDataFrame(rs, SCHEMA))) == [(1, 15, "e", None), (1, 2, "a", 5), (1, 2, "b", 4), (1, 9, "a", 10), (1, 9, "c", None), (2, 1, "a", None)]
    none = spark.createDataFrame([], SCHEMA)
    assert [t.collect() for t in T.repair(none)] == [[], []]


def test_stale_calls(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "c"), (1, 8, "a"), (1, 8, "n"), (1, 1, None)], "session long, at long, call_id string")
    results = spark.createDataFrame([(1, 2, "a", True), (1, 2, "b", False), (1, 1, "c", True)], "session long, at long, call_id string, selected boolean")
    assert rows(T.drop_stale_calls(calls, results, 5)) == [(1, 1, "a"), (1, 1, None), (1, 8, "n")]


def test_three_ways_of_assembling(spark):
    texts = {0: "apples and pears", 1: "pears " * 40, 2: "nothing of it", 3: "pears", 4: None, 5: "the newest"}
    items = spark.createDataFrame([(c, o, n, t) for c in (1, 2, 3, 4) for o, (n, t) in enumerate(zip((30, 200, 30, 30, None, 50), texts.values(), strict=True))], "conversation_id long, ordinal long, token_count long, content string")
    prompts = spark.createDataFrame([(1, "Pears!"), (2, "  "), (4, None)], "conversation_id long, prompt string")
    got = {}
    for r in A.assemble(items, prompts, 1, 120).collect():
        got.setdefault((r.conversation_id, r.mode), set()).add(r.ordinal)
    assert got == {(1, "prompt-aware"): {0, 3, 4, 5}, (2, "chronological"): {2, 3, 4, 5}, (3, "chronological"): {2, 3, 4, 5}, (4, "chronological"): {2, 3, 4, 5}}
    assert {r.mode for r in A.assemble(items, prompts, 1, 10_000).collect()} == {"full-fit"}
    assert {r.ordinal for r in A.assemble(items.where("conversation_id = 1"), prompts, 1, 10).collect()} == {4, 5}  # the tail alone is over the budget; what has no tokens still fits


def test_guard_and_its_way_back(spark):
    run = ("QUJDREVGR0hJSktM" * 400)[:5000]
    uri = "data:image/png;base64," + run[:300]
    texts = [f"see {uri} and {uri}", f"a {run} b", f"{run} {uri}", "x" * 6000, run[:4097], "data:;base64,QUJD", None, "", f'{{"u": "{uri[:30]}\\/{uri[30:]}"}}', run + "A" * 4 + " " + run, "漢字 " + uri]
    m = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], M)
    out, links, stored = P.guard(m)
    got = {r.message_id: r.content for r in out.collect()}
    assert re.fullmatch(r"see (\[payload file_[0-9a-f]{16}\]) and \1", got[0])
    assert got[3] == texts[3] and got[5] == texts[5] and got[6] is None and got[7] == ""
    assert got[4] == texts[4]  # no base64 has a length of 4n + 1
    assert "base64" not in got[8] and got[2].count("[payload") == 2 and got[9].count("[payload") == 2
    assert {r.content for r in stored.collect()} >= {uri, run}
    assert rows(P.restore(out, stored)) == rows(m.select("message_id", "content"))
    assert P.conversation_payloads(links, stored).count() == links.select("conversation_id", "file_id").distinct().count()
    assert [t.collect() for t in P.guard(m.limit(0))] == [[], [], []]


def walk(v, depth=0):
    if depth >= 4 or v is None:
        return []
    if isinstance(v, str):
        return [v] if v else []
    if isinstance(v, list):
        return [t for x in v for t in walk(x, depth + 1)]
    if not isinstance(v, dict) or str(v.get("type", "")).lower() in ("reasoning", "thinking"):
        return []
    own = [v[k] for k in ("text", "caption", "alt", "title", "summary") if isinstance(v.get(k), str) and v[k]]
    if str(v.get("type", "")).lower() in ("file", "image", "snapshot"):
        return own
    return own + [t for k in ("content", "parts", "items", "message", "messages") for t in walk(v.get(k), depth + 1)]


def test_text_of_nested_content(spark):
    values = [["a", {"text": "b", "content": ["c", {"text": "d", "parts": [{"text": "too deep"}]}]}], {"type": "Thinking", "text": "no"}, {"title": "t", "alt": "al", "messages": [{"type": "image", "caption": "cap", "content": "no"}, None, 5, True]}, [], {}, {"text": 7, "items": "it"}, [[["x", ["deep"]]]], {"message": {"content": "m"}, "content": "first"}]
    m = spark.createDataFrame([(i, 1, json.dumps(v)) for i, v in enumerate(values)] + [(90, 1, "{not json}"), (91, 1, None), (92, 1, " plain \n\n MEDIA:/x \n line ")], M)
    got = {r.message_id: r.text for r in P.meaningful_text(m).collect()}
    assert {k: got[k] for k in range(len(values))} == {i: "\n".join(walk(v)) for i, v in enumerate(values)}
    assert (got[90], got[91], got[92]) == ("{not json}", "", "plain\n line")


def test_parts_of_messages(spark):
    blocks = [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "c1", "name": "look", "input": {"q": [1, "x"]}}, {"type": "text", "id": "i"}, "bare", {"type": "tool_result", "call_id": "c1", "output": "done", "content": "s"}, 5, None]
    m = spark.createDataFrame([(1, 1, json.dumps(blocks)), (2, 1, "plain"), (3, 1, '{"a": 1}'), (4, 1, None), (5, 1, "[]"), (6, 1, "")], M)
    got = {(r.message_id, r.ordinal): (r.part_type, r.text_content, r.tool_call_id, r.tool_name, r.tool_input, r.tool_output) for r in P.message_parts(m).collect()}
    assert got[1, 0] == ("text", "hi", None, None, None, None)
    assert got[1, 1] == ("tool", None, "c1", "look", '{"q":[1,"x"]}', None)
    assert got[1, 2] == ("text", None, None, None, None, None) and got[1, 3][:2] == ("text", "bare")
    assert got[1, 4] == ("tool", "s", "c1", None, None, '"done"') and got[1, 5][:2] == ("text", "5")
    assert got[2, 0][:2] == ("text", "plain") and got[3, 0][0] == "agent" and got[6, 0][:2] == ("text", None)
    assert not {k for k in got if k[0] in (4, 5)}
