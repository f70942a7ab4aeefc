"""Structure repair against a search over all audits."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from recall_spark.llm import structure as S

SCHEMA = "conv_id long, turn long, role string, text string, copy long, digest string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = "user" if k == 4 else word(role), "" if k == 1 else re.sub("[.!?]", "", word(text)) if k == 2 else word(text)
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def search(rows, symbols):
    """Cheapest edits by (cost, audit), by going through all of them in that order; fit for a handful of rows."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, out, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit, "\n".join(lines)
        if not re.fullmatch("(s?(ua)*u?)?", out) or cost > 40:
            continue
        for initial, role in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 5, audit + "I", i, out + initial, (*lines, f"{role}:")))
        if i < len(rows):
            role, text = rows[i][2], rows[i][3]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out, lines))
            if symbols[i] not in ("blank", "duplicate"):
                more = 5 * (symbols[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for initial, to in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, out + initial, (*lines, f"{to}:{text}")))
    raise AssertionError


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        rs = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, symbols = set(), []
        for r in rs:
            body = r[3].rstrip(" \t\n\v\f\r")
            symbols.append("blank" if not body else "duplicate" if r[2:] in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add(r[2:])
        turns = {r[1] for r in rs} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rs, rs[1:])]
        cost, audit, text = search(rs, symbols)
        out[conv] = (gaps, *(symbols.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why? ", "Yes.", "é.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]
    out = []
    for conv in range(400):
        n = int(rng.integers(1, 7))
        for turn in range(n):
            role = roles[turn % 2] if rng.random() < 0.6 else roles[int(rng.integers(len(roles)))]
            out.append((conv, turn * int(rng.integers(1, 3)) if rng.random() < 0.9 else None, role, texts[int(rng.integers(len(texts)))]))
    return [*out, (None, 0, "user", "Q?"), (None, None, "assistant", "A."), *[(900, 3, "user", "Same.")] * 3]


def test_against_a_search_over_all_audits(spark, rows):
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(5)
    got = S.repair(S.with_damage(table)).collect()
    found = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    assert found == expected(rows)


def test_nodes_are_shared():
    graph = S.Graph()
    words = sorted({"".join(w) for w in (["u", "a"] * 3, ["s", "u", "a"], ["u", "a"], ["a", "u", "a"], ["u", "u", "a"])} | {w[::-1] for w in ("sua", "suaua", "ua")})
    for w in words:
        graph.audit(w)
    assert graph.made == len({w[: i + 1] for w in words for i in range(len(w))})  # a node for each different suffix


def test_long_conversation(spark):
    n = 50_000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('line ', id, '.') as text", "id % 1000 = 1 as gone")
    got = S.repair(rows).collect()
    assert len(got) == 1 and got[0].gaps == 50 and len(got[0].audit) >= n - 50
    assert got[0].illegal == 50 and got[0].cost == 50 * 2  # of two users in a row one goes


def test_empty_table(spark):
    assert S.repair(S.with_damage(spark.createDataFrame([], SCHEMA))).collect() == []
