"""Chat formatting: a finite-state machine over roles, segments with loss flags, a declarative template, and the way back.

A template gives each role its opening and closing marks and whether its text is trained on, and the role machine's
transitions. Control strings inside texts get an escape before them, so the marks are the only bare ones and every
conversation, also one whose turns are out of order, can be read back. The machine says where the order breaks.

A conversation's rows are dealt by conv_id and sorted by turn; tasks stream them, so none is held whole, however long.
Nulls: text and role count as empty, null turns come first, rows without a conv_id form a conversation. Rows that
repeat are turns of their own; of equal turns the order is by role, then text. Empty texts give empty segments, an empty table none.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ESCAPE = "\\"
#: Rows of an Arrow batch that a task emits.
ROWS = 2_000


@dataclass(frozen=True)
class Part:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks and transitions. Roles that `parts` lacks are named inside `other`'s opening mark, before `named`."""

    parts: dict[str, Part] = field(default_factory=dict)
    other: Part = Part("[TURN]", "[/TURN]")
    named: str = "[TEXT]"
    begin: str = "<s>"
    end: str = ""
    #: (state, role) -> state; the machine starts in "start" and may stop in `accepts`. After a fault it goes on as if the role's turn had been legal; a role without moves leaves it where it was.
    moves: tuple[tuple[str, str, str], ...] = ()
    accepts: tuple[str, ...] = ("start", "assistant")

    def __post_init__(self):
        marks = self.controls()
        for a in marks:
            for b in marks:
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise ValueError(f"a text's end and the mark {b!r} could read as {a!r}")
        openings = [p.open for p in [*self.parts.values(), self.other]]
        if len(set(openings)) < len(openings) or not all(p.close for p in [*self.parts.values(), self.other]):
            raise ValueError("roles need different openings, and every closing a mark")

    def controls(self) -> list[str]:
        found = {self.begin, self.end, self.named, self.other.open, self.other.close, *(m for p in self.parts.values() for m in (p.open, p.close))}
        return sorted((m for m in {x.strip() for x in found} if m), key=lambda m: (-len(m), m))

    def step(self, state: str, role: str) -> str | None:
        return next((to for at, r, to in self.moves if at == state and r == role), None)

    def resumed(self, state: str, role: str) -> str:
        return next((to for _, r, to in self.moves if r == role), state)


#: Instruction marks as public instruction-tuned models have them; assistants' texts stand bare before their closing mark.
INSTRUCT = Template(
    parts={"system": Part("<<SYS>>", "<</SYS>>"), "user": Part("[INST] ", " [/INST]"), "assistant": Part("", "</s>", True)},
    moves=(("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user")),
)
#: Named turns between two marks.
MARKED = Template(
    parts={r: Part(f"<|start|>{r}<|text|>", "<|end|>", r == "assistant") for r in ("system", "user", "assistant")},
    other=Part("<|other|>", "<|close|>"), named="<|named|>", begin="", end="<|stop|>", moves=INSTRUCT.moves,
)


def _escaper(t: Template) -> re.Pattern:
    return re.compile("|".join(map(re.escape, [ESCAPE, *t.controls()])))


def _row_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield from b.slice(i, ROWS).to_pylist()


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("legal", pa.bool_())])
_SEGMENTS_DDL = "conv_id long, segment long, turn long, text string, loss boolean, legal boolean"


def format_chats(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, segment, turn, text, loss, legal) of conversations (conv_id, turn, role, text), in the order of (conv_id, segment) within partitions.

    A conversation's segments, laid end to end, are its formatted text; loss marks what is trained on. legal is false
    on the segments of a turn that the role machine refuses, and on the last segment of a conversation that may not stop there.
    """
    t, special = template, _escaper(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments():
            now, number, state = object(), 0, "start"
            escaped = lambda s: special.sub(lambda m: ESCAPE + m[0], s)
            for row in _streamed(batches):
                conv, role, text = row["conv_id"], row["role"] or "", row["text"] or ""
                if conv != now:
                    if number:
                        yield now, number, None, t.end, False, state in t.accepts
                    now, number, state = conv, 0, "start"
                    yield conv, 0, None, t.begin, False, True
                    number = 1
                to = t.step(state, role)
                part = t.parts.get(role)
                opening, closing, loss = (part.open, part.close, part.loss) if part else (t.other.open + escaped(role) + t.named, t.other.close, t.other.loss)
                for piece, trained in ((opening, False), (escaped(text), loss), (closing, False)):
                    yield conv, number, row["turn"], piece, trained, to is not None
                    number += 1
                state = to if to is not None else t.resumed(state, role)
            if number:
                yield now, number, None, t.end, False, state in t.accepts

        yield from _row_batches(segments(), _SEGMENTS)

    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _SEGMENTS_DDL)


class Reader:
    """Reads a formatted conversation, given in pieces that cut no mark, and yields its turns as ("role", x), ("text", x) and ("end", "") parts."""

    def __init__(self, template: Template):
        t = self.template = template
        self.special = re.compile("|".join([re.escape(ESCAPE) + "(?:" + "|".join(map(re.escape, [ESCAPE, *t.controls()])) + ")", *map(re.escape, sorted(filter(None, {t.begin, t.end, t.other.open, t.other.close, t.named, *(m for p in t.parts.values() for m in (p.open, p.close))}), key=lambda m: -len(m)))]))
        self.openings = {p.open: (r, p) for r, p in t.parts.items()}
        self.role, self.part, self.name, self.fresh = None, None, None, True

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        t, at = self.template, 0
        for m in self.special.finditer(piece):
            yield from self._plain(piece[at : m.start()])
            at, mark = m.end(), m[0]
            if mark[0] == ESCAPE:
                yield from self._plain(mark[1:])
            elif self.name is not None and mark == t.named:
                self.part = t.other
                yield "role", "".join(self.name)
                self.name = None
            elif self.part is None and self.name is None:
                if self.fresh and mark == t.begin or mark == t.end:
                    self.fresh = False
                elif mark in self.openings:
                    yield self._opened(mark)
                elif mark == t.other.open:
                    self.name = []
                elif "" in self.openings and mark == self.openings[""][1].close:
                    yield self._opened("")
                    yield self._closed()
                else:
                    raise ValueError(f"{mark!r} between turns")
            elif self.part is not None and mark == self.part.close:
                yield self._closed()
            else:
                raise ValueError(f"bare {mark!r} inside a turn")
        yield from self._plain(piece[at:])

    def _plain(self, s: str) -> Iterator[tuple[str, str]]:
        if not s:
            return
        if self.name is not None:
            self.name.append(s)
            return
        if self.part is None:
            if "" not in self.openings:
                raise ValueError(f"{s[:40]!r} between turns")
            yield self._opened("")
        yield "text", s

    def _opened(self, mark: str) -> tuple[str, str]:
        role, self.part = self.openings[mark]
        return "role", role

    def _closed(self) -> tuple[str, str]:
        self.part = None
        return "end", ""


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_illegal", pa.int64()), ("order_ok", pa.bool_())])
_DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_illegal long, order_ok boolean"


def read_back(segments: DataFrame, template: Template = INSTRUCT, in_order: bool = False) -> DataFrame:
    """Digests of what a reader finds in formatted conversations: turns, text under the loss mask, sizes, illegal turns, and whether the order is legal.

    Only text and loss of the segments are read; roles and texts come from the marks. in_order: the partitions are as format_chats leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests():
            now = object()
            reader = turns = loss = None
            n = chars = trained = bad = last = 0
            ok = True
            unmark = re.compile(re.escape(ESCAPE) + "(" + "|".join(map(re.escape, [ESCAPE, *template.controls()])) + ")")
            for row in _streamed(batches):
                if row["conv_id"] != now:
                    if reader:
                        yield now, n, turns.hexdigest(), trained, loss.hexdigest(), chars, bad, ok
                    now, reader, turns, loss = row["conv_id"], Reader(template), hashlib.sha256(), hashlib.sha256()
                    n, chars, trained, bad, last, ok = 0, 0, 0, 0, None, True
                text = row["text"]
                chars += len(text)
                if not row["legal"]:
                    ok = False
                    bad, last = bad + (text != template.end and n != last), n if text != template.end else last
                if row["loss"]:
                    plain = unmark.sub(r"\1", text)
                    trained += len(plain)
                    loss.update(plain.encode())
                for what, x in reader.feed(text):
                    if what == "role":
                        turns.update(f"{x}\n".encode())
                    elif what == "text":
                        turns.update(x.encode())
                    else:
                        turns.update(b"\n")
                        n += 1
            if reader:
                yield now, n, turns.hexdigest(), trained, loss.hexdigest(), chars, bad, ok

        yield from _row_batches(digests(), _DIGEST)

    lined = segments.select("conv_id", "segment", "turn", "text", "loss", "legal")
    return (lined if in_order else lined.repartition("conv_id").sortWithinPartitions("conv_id", "segment")).mapInArrow(run, _DIGEST_DDL)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_chats(rows.union(more)), in_order=True)


QUERIES = {"op12_chat_format": op12_chat_format}
ORACLES: dict[str, str] = {}
