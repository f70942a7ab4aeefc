"""Chat formatting: exact round trips, loss text and order."""

import hashlib

import pytest

from recall_spark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, extra string, segment long"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST] ", "[INST[INST]]", "<<SYS>><</SYS>>", "", " ", " [/INST", "\n", "<s", "s>", "漢字 \\</s>\\", "[TEXT][TURN]", "<|end|>", "<|end|", "x" * 200_000 + "</s>"]


@pytest.fixture(scope="module")
def rows():
    out = []
    for i, t in enumerate(NASTY):
        out += [(i, 0, "system", t), (i, 1, "user", t), (i, 2, "assistant", t), (i, 3, "user", NASTY[(i + 1) % len(NASTY)]), (i, 4, "assistant", NASTY[(i + 2) % len(NASTY)])]
        out += [(100 + i, 0, "assistant", t), (100 + i, 1, "assistant", t), (100 + i, 2, "tool[TEXT]", t), (100 + i, 3, "system", t), (100 + i, 4, None, None), (100 + i, None, "user", t)]
    return [*out, (500, 1, "user", "same"), (500, 1, "user", "same"), (500, 1, "assistant", "same"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (501, 0, "user", "no answer")]


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), (r[3] or "").encode()))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs)
        loss = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        out[conv] = (len(rs), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("template", [C.INSTRUCT, C.MARKED])
def test_round_trip(spark, rows, template):
    segments = C.format_chats(spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(5), template).cache()
    for in_order in (True, False):
        got = {r.conv_id: r for r in C.read_back(segments, template, in_order).collect()}
        assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == expected(rows)
    whole = {}
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id or -1, r.segment)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    assert {k: len(v) for k, v in whole.items()} == {k: r.formatted_chars for k, r in got.items()}
    for conv, text in whole.items():  # one reader over the whole text, without segments
        parts = list(C.Reader(template).feed(text))
        assert sum(what == "end" for what, _ in parts) == got[conv].n_turns
    assert got[0].order_ok and got[0].n_illegal == 0
    assert not got[501].order_ok and got[501].n_illegal == 0  # stops after the user
    assert not got[100].order_ok and got[100].n_illegal == 4  # user, assistant are legal; then assistant, tool, system and null are not
    segments.unpersist()


def test_format_itself(spark):
    rows = [(1, 0, "system", "Be [INST]."), (1, 1, "user", "a\\b"), (1, 2, "assistant", "yes")]
    got = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert "".join(r.text for r in got) == "<s><<SYS>>Be \\[INST].<</SYS>>[INST] a\\\\b [/INST]yes</s>"
    assert [r.text for r in got if r.loss] == ["yes"]


def test_templates_whose_marks_could_straddle_are_refused():
    with pytest.raises(ValueError, match="could read as"):
        C.Template(parts={"user": C.Part("<a<", "<b>"), "assistant": C.Part("<", ">")})
    with pytest.raises(ValueError, match="openings"):
        C.Template(parts={"user": C.Part("(u)", "(e)"), "assistant": C.Part("(u)", "(e)")})


def test_damaged_output_is_refused():
    with pytest.raises(ValueError, match="bare"):
        list(C.Reader(C.INSTRUCT).feed("<s>[INST] a [INST] b [/INST]"))


def test_empty_table(spark):
    empty = C.format_chats(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and C.read_back(empty).collect() == []
