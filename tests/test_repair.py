"""Repair of damaged summaries against a version that works through one conversation after another."""

import datetime
import random

from pyspark.sql import functions as F

from recall_spark.operators import graph as D
from recall_spark.operators import repair as R

NODE = "conversation_id long, summary_id string, depth int, content string, earliest_at timestamp, latest_at timestamp, created_at timestamp, token_count long"
EDGE, LINK = "summary_id string, source_summary_id string, ordinal long", "summary_id string, message_id long, ordinal long"
MESSAGE, ITEM = "message_id long, content string, created_at timestamp", "conversation_id long, summary_id string, ordinal long"
BAD = "[Truncated from 999 tokens]"


def at(n):
    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def previous(x, nodes, edges, context):
    told = {n[1] for n in nodes if (n[3] or "").strip()}
    kin = {n[1]: n for n in nodes if n[0] == x[0] and (n[2] or 0) == (x[2] or 0)}
    mine = [o for _, s, o in context if s == x[1]]
    orders = []
    if mine:
        orders.append(("context", [s for o, s in sorted((o, s) for _, s, o in context if s in kin and o < min(mine))]))
    over = sorted((p, o) for p, s, o in edges if s == x[1])
    if over:
        known = {n[1] for n in nodes}
        orders.append(("siblings", [s for o, s in sorted((o, s) for p, s, o in edges if p == over[0][0] and o < over[0][1] and s in known)]))
    if x[6] is not None:
        orders.append(("time", [s for c, s in sorted((n[6], n[1]) for n in kin.values() if n[6] is not None) if (c, s) < (x[6], x[1])]))
    for via, before in orders:
        if before and before[-1] in told:
            return before[-1], via
    return None, None


def sequential(nodes, edges, links, messages, context, uses_previous):
    texts, out = {n[1]: (n[3] or "").strip() for n in nodes}, []
    ms, by, written = {m[0]: m for m in messages}, {n[1]: n for n in nodes}, lambda t: t.strftime("%Y-%m-%d %H:%M:%S") if t else "unknown"
    place = {}
    for _, s, o in context:
        place[s] = min(o, place.get(s, o))
    key = lambda n: (0, place[n[1]], 0, 0, "") if not n[2] and n[1] in place else (2 if n[2] else 1, 0, n[2] or 0, n[6] is not None, n[6] or 0, n[1])
    for n in sorted((n for n in nodes if n[3] and BAD in n[3]), key=lambda n: (n[0], *key(n))):
        if not n[2]:
            found = [ms[m] for _, m, _ in sorted((o, m, s) for s, m, o in links if s == n[1] and m in ms)]
            source, why = "\n\n".join(f"[{written(m[2])}]\n{m[1] or ''}" for m in found), None if found else "no messages linked to summary"
        else:
            found = [by[s] for _, s in sorted((o, s) for p, s, o in edges if p == n[1] and s in by)]
            blocks = [(c[4] or c[6], c[5] or c[6], texts[c[1]]) for c in found if texts[c[1]]]
            source = "\n\n".join((f"[{written(a)} - {written(b)}]\n" if a and b else "") + t for a, b, t in blocks)
            why = None if blocks else "child summaries resolved empty" if found else "no child summaries linked to summary"
        p = previous(n, nodes, edges, context)[0] if uses_previous else None
        new = f"{n[2] or 0}|{texts[p][:9] if p else '-'}|{source[-60:]}".strip()
        why = why or ("rewritten content still contains a doctor marker" if BAD[:16] in new and len(new) - new.index(BAD[:16]) < 40 else None)
        if not why:
            texts[n[1]] = new
        out.append((n[1], "skipped" if why else "repaired", why, None if why else new))
    return sorted(out)


def case(seed):
    """Three conversations of leaves, condensed ones over them and some over these, with gaps of every kind."""
    r = random.Random(seed)
    nodes, edges, links, messages, context = [], [], [], [], []
    for c in (1, 2, 3):
        leaves = [f"l{c}{i}" for i in range(7)]
        middle, top = [f"m{c}{i}" for i in range(3)], [f"t{c}"]
        for depth, ids in enumerate((leaves, middle, top)):
            for i, s in enumerate(ids):
                text = r.choice([f"text of {s}", f"some {s} " + BAD, f"other {s} " + BAD, f" {s}{BAD}", " ", None])
                t = r.choice([None, i * 10, i * 10, 5])
                nodes.append((c, s, None if depth == 0 and r.random() < 0.3 else depth, text, at(t) if r.random() < 0.5 else None, at(90 if t else None), at(t), 1))
        for i, s in enumerate(leaves):
            for k in range(r.choice([0, 1, 2, 3])):
                messages.append((100 * c + 10 * i + k, r.choice(["hello there", None, f"word {k} of {s}"]), at(r.choice([None, k]))))
                links.append((s, 100 * c + 10 * i + k, k))
            if r.random() < 0.7:
                edges.append((middle[i // 3], s, i % 3))
        links.append((leaves[0], 9999, 7))
        edges += [(top[0], m, i) for i, m in enumerate(middle) if r.random() < 0.8] + [(top[0], leaves[6], 7), (top[0], "gone", 8)]
        shown = [s for s in leaves + middle + top if r.random() < 0.5]
        context += [(c, s, o) for o, s in enumerate(shown)] + ([(c, shown[0], 50)] if shown else [])
    return nodes, edges, links, messages, context


def frames(spark, tables):
    return [spark.createDataFrame(t, s) for t, s in zip(tables, (NODE, EDGE, LINK, MESSAGE, ITEM))]


def rewrite(source, told, depth):
    return F.concat_ws("|", depth.cast("string"), F.coalesce(F.substring(told, 1, 9), F.lit("-")), F.substring(source, F.greatest(F.lit(1), F.length(source) - 59), F.lit(60)))


def test_previous_by_three_orders(spark):
    seen = set()
    for seed in range(3):
        tables = case(seed)
        nodes, edges, _, _, context = frames(spark, tables)
        want = sorted((n[1], *previous(n, tables[0], tables[1], tables[4])) for n in tables[0])
        assert sorted(map(tuple, R.previous_summaries(nodes, edges, context).collect())) == want
        seen |= {via for _, _, via in want}
    assert seen == {"context", "siblings", "time", None}


def test_repairs_feed_the_next_ones(spark):
    reasons = set()
    for seed, uses in ((0, True), (1, True), (2, False)):
        tables = case(seed)
        out = R.repair_texts(*frames(spark, tables), rewrite, uses)
        got = sorted(map(tuple, out.select("summary_id", "status", "reason", "content").collect()), key=lambda x: x[0])
        assert got == sequential(*tables, uses)
        reasons |= {r for _, _, r, _ in got}
        after = R.with_repairs(frames(spark, tables)[0], out)
        new = {s: t for s, status, _, t in got if status == "repaired"}
        assert sorted(map(tuple, after.select("summary_id", "content").collect())) == sorted((n[1], new.get(n[1], n[3])) for n in tables[0])
        assert after.count() == len(tables[0])
    assert {"no messages linked to summary", None} < reasons


def test_right_texts_and_blank_rewrites(spark):
    tables = [[(1, "a", 0, "x " + BAD, None, None, at(1), 1), (1, "b", 0, BAD, None, None, at(2), 1), (2, "c", 0, "fine", None, None, None, 1)], [], [("a", 1, 0), ("b", 1, 0)], [(1, "hi", at(0))], []]
    same = R.repair_texts(*frames(spark, tables), lambda source, told, depth: F.when(told.isNull(), F.lit("x " + BAD)).otherwise(F.lit("  ")))
    assert sorted((r.summary_id, r.status, r.reason) for r in same.collect()) == [("a", "skipped", "rewritten content still contains a doctor marker"), ("b", "skipped", "summarizer returned empty output")]
    whole = frames(spark, tables)
    assert R.repair_texts(whole[0].where("conversation_id = 2"), *whole[1:], rewrite).collect() == []
    assert R.repair_texts(whole[0].limit(0), *[t.limit(0) for t in whole[1:]], rewrite).collect() == []


def test_manifest_of_odd_nodes(spark):
    """A shared node counts once at its least depth, a suppressed one is passed through, a cycle ends, odd sizes are 0."""
    node = "summary_id string, token_count long, descendant_tokens long, source_tokens long, created_at timestamp, suppressed boolean"
    nodes = spark.createDataFrame([("a", 10, 40, 100, at(1), None), ("b", 5, None, 7, None, True), ("c", -3, 20, 9, at(1), False), ("d", None, None, None, None, False), ("lone", 1, 1, 1, None, False)], node)
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 3), ("d", "a", 0), ("c", "gone", 4)], EDGE)
    roots = spark.createDataFrame([("a", 50), ("a", 50), ("lone", None), ("gone", 3)], "root string, budget int")
    got = sorted(map(tuple, D.manifest(nodes, edges, roots, 2).collect()))
    assert got == [
        ("a", "a", None, 0, "", 2, 50, 150, True, False, 3),
        ("a", "c", "a", 1, "0001", 2, 20, 29, True, True, 3),
        ("a", "d", "b", 2, "0000.0000", 1, 0, 0, True, True, 3),
        ("lone", "lone", None, 0, "", 0, 2, 3, True, False, 1),
    ]
    assert [r.summary_id for r in D.manifest(nodes, edges, roots.where("root = 'a'"), 2, 2).orderBy("depth").collect()] == ["a", "c"]
    assert D.manifest(nodes, edges, roots.limit(0), 2).count() == 0 and D.manifest(nodes.limit(0), edges, roots, 2).count() == 0


def test_plan_names_each_finding(spark):
    tables = [
        spark.createDataFrame([(1,), (3,)], "conversation_id long"),
        spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 20, 1), (None, 30, 5), (3, 31, 0), (3, 32, 0)], "conversation_id long, message_id long, seq long"),
        spark.createDataFrame([(1, "a", None), (1, "b", 1), (1, "c", 0)], "conversation_id long, summary_id string, depth int"),
        spark.createDataFrame([("b", "a", 0)], EDGE), spark.createDataFrame([("c", 10, 0), ("c", 11, 1)], LINK),
        spark.createDataFrame([(1, 0, "message", "10"), (1, 1, "summary", "b"), (1, 3, "message", "10"), (1, 4, "summary", "none"), (None, 7, "summary", "x")], "conversation_id long, ordinal long, item_type string, ref string"),
    ]
    got = sorted(map(tuple, R.repair_plan(*tables).collect()))
    assert got == sorted([
        (2, "conversation_exists", "Create or restore conversation 2 in the conversations table"),
        (1, "context_items_contiguous", "Resequence context items to fix ordinal gaps"),
        (1, "context_items_valid_refs", "Remove context item at ordinal 4 referencing missing summary none"),
        (1, "summaries_have_lineage", "Add missing lineage for leaf summary a (link to source messages via summary_messages)"),
        (1, "no_orphan_summaries", "Remove orphaned summary c from summaries table"),
        (2, "message_seq_contiguous", "Resequence message seq values to eliminate gaps (renumber starting from 0)"),
        (3, "message_seq_contiguous", "Resequence message seq values to eliminate gaps (renumber starting from 0)"),
        (1, "no_duplicate_context_refs", "Deduplicate message 10: keep ordinal 0, remove ordinals 3"),
    ])
    assert R.repair_plan(*[t.limit(0) for t in tables]).count() == 0
