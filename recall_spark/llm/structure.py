"""Conversation structure repair over a suffix-shared word graph of role and fault signatures.

A conversation's rows become a signature, a symbol a row: role initial (s, u, a, other) and fault (none, truncated,
must go). Signatures of all conversations are sorted by their reversal, so those that end alike stand together and
share their last nodes; a task walks them with a stack and makes one node for each different suffix. A node holds, for each
state of the grammar `(s?(ua)+)?`, the least cost of the rest and the edits that begin the best audit of it, which are worked
out once from the node behind it. Nodes whose costs differ by a constant share one table of steps.

The best edit of a node and state: least cost, then least letter. Edits of one letter lead from a state to one state only, so
least letters in turn give the least audit.

A conversation's length is bounded only by its audit, which the result holds; texts are streamed, a row at a time.
Repeats are found by aggregating digests, so neither a long conversation nor a very common row meets in one task.
Nulls in role and text stand for one space, so do nulls in conv_id and turn within the damaged rows' keys; null turns come first; rows of one
turn are ordered by role and text digest; rows without a conv_id form a conversation. Rows that repeat count each time. Empty
texts are blank. Empty tables give empty tables. Columns besides these four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import _row_batches, _streamed
from .common import forget, saved, table

# Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a. A repaired conversation ends in the first or last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Initial that each state wants next; s fits only at the start.
WANTS, AFTER = "uuau", (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Symbols: initial in lower case as it is, in upper case if truncated, - for a row that must go, . for other initials, : for those truncated.
MUST_GO, OTHER, OTHER_CUT = "-", ".", ":"

_BLANKS = "[\\x20\\x09-\\x0D]"


def with_damage(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with copy and gone: every row damaged by crc32 of `conv_id:turn` modulo 20.

    0: the row is gone, 1: its text is empty, 2: it loses its [.!?], 3: a copy follows, 4: its role is user.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(k == 4, "user").otherwise(word("role"))
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (k == 0).alias("gone"), copies.alias("copies")).withColumn("copy", F.explode("copies")).drop("copies")


def _lined(rows: DataFrame) -> DataFrame:
    """Rows that aren't gone, without their texts: (conv_id, turn, role, digest, m equal rows, blank, cut, first of its role and text)."""
    body = F.regexp_replace("text", f"{_BLANKS}+$", "")
    marked = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"))
    own = marked.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("m"))
    key = F.struct(F.col("turn").isNotNull().alias("set"), "turn")
    first = own.groupBy("conv_id", "role", "digest").agg(F.min(key).alias("x")).select("conv_id", F.col("x.turn").alias("turn"), "role", "digest", F.lit(True).alias("first"))
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "turn", "role", "digest")]
    return own.alias("o").join(first.alias("f"), on, "left").select("o.*", F.coalesce("f.first", F.lit(False)).alias("first"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_SIGNED = pa.schema([("conv_id", pa.int64()), ("reversed", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
_SIGNED_DDL = "conv_id long, reversed string, gaps long, blank long, duplicate long, truncated long, illegal long"


class _Signing:
    """Signature and counts of one conversation while its rows pass in order."""

    def __init__(self):
        self.symbols, self.before, self.low, self.high, self.turns = [], None, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, row: dict) -> None:
        turn, initial = row["turn"], row["role"][:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        for i in range(row["m"]):
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            if row["blank"]:
                self.blank += 1
            elif i or not row["first"]:
                self.duplicate += 1
            else:
                known = initial in ("s", "u", "a")
                self.truncated += row["cut"]
                self.symbols.append((initial.upper() if known else OTHER_CUT) if row["cut"] else initial if known else OTHER)
                continue
            self.symbols.append(MUST_GO)

    def done(self, conv) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return conv, "".join(reversed(self.symbols)), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures, from the end on, of rows sorted by conversation and place; rows without m only name a conversation."""

    def signed():
        now, held = object(), None
        for row in _streamed(batches):
            if row["conv_id"] != now:
                if held:
                    yield held.done(now)
                now, held = row["conv_id"], _Signing()
            if row["m"] is not None:
                held.add(row)
        if held:
            yield held.done(now)

    yield from _row_batches(signed(), _SIGNED)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, reversed signature, gaps, blank, duplicate, truncated, illegal) of every conversation of with_damage's rows."""
    named = rows.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("m", "long"), ("blank", "boolean"), ("cut", "boolean"), ("first", "boolean"))])
    lined = _lined(rows.where(~F.col("gone"))).select("conv_id", "turn", "role", "digest", "m", "blank", "cut", "first").union(named)
    return lined.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").mapInArrow(_sign, _SIGNED_DDL)


class Graph:
    """Nodes of suffixes, as a stack for the suffixes of one signature: those that the next one shares stay."""

    END = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""))

    def __init__(self):
        self.word, self.made, self.steps = "", 0, {}
        #: (costs less their least, that least summed up, steps by state)
        self.nodes = [(self.END[0], 0, None)]

    def step(self, symbol: str, behind: tuple) -> tuple:
        """(costs less their least, their least, (letters, next state) by state) of a node with this symbol before costs `behind`."""
        found = self.steps.get((symbol, behind))
        if found:
            return found
        cut = CUT if symbol in "SUA" + OTHER_CUT else 0
        best = []
        for state in range(4):
            options = [(DELETE + behind[state], "D", state)]
            if symbol != MUST_GO:
                options.append((REROLE + cut + behind[AFTER[state]], "R", AFTER[state]))
                if symbol.lower() == WANTS[state]:
                    options.append((cut + behind[AFTER[state]], "K", AFTER[state]))
                if state == START and symbol.lower() == "s":
                    options.append((cut + behind[AFTER_S], "K", AFTER_S))
            best.append(min(options))
        for _ in range(4):  # inserts lead through at most all states
            best = [min(b, (INSERT + best[AFTER[s]][0], "I" + best[AFTER[s]][1], best[AFTER[s]][2])) for s, b in enumerate(best)]
        least = min(c for c, _, _ in best)
        found = tuple(c - least for c, _, _ in best), least, tuple((letters, to) for _, letters, to in best)
        self.steps[symbol, behind] = found
        return found

    def audit(self, word: str) -> tuple[int, str]:
        """Cost and audit of a reversed signature."""
        shared = 0
        for a, b in zip(word, self.word):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in word[shared:]:
            costs, base, _ = self.nodes[-1]
            own, least, steps = self.step(symbol, costs)
            self.nodes.append((own, base + least, steps))
            self.made += 1
        self.word = word
        state, letters = START, []
        for _, _, steps in reversed(self.nodes[1:]):
            edits, state = steps[state]
            letters.append(edits)
        return self.nodes[-1][1] + self.nodes[-1][0][START], "".join(letters) + self.END[1][state]


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def audited():
        graph, last, found = Graph(), None, None
        for row in _streamed(batches):
            if row["reversed"] != last:
                last = row["reversed"]
                found = graph.audit(last)
            yield row["conv_id"], *(row[c] for c in _COUNTS), *found

    yield from _row_batches(audited(), _AUDITED)


_AUDITED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string())])
_AUDITED_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(signed: DataFrame) -> DataFrame:
    """signatures' rows with cost and audit; signed is read twice, once to deal signatures by their ends."""
    return signed.repartitionByRange("reversed", "conv_id").sortWithinPartitions("reversed", "conv_id").mapInArrow(_audit, _AUDITED_DDL)


class _Repairing:
    """Repaired lines of one conversation while its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self.wanted(), ""
            self.at += 1

    def wanted(self) -> str:
        role, self.state = "user" if WANTS[self.state] == "u" else "assistant", AFTER[self.state]
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "R":
            yield self.wanted(), text
        elif letter == "K":
            self.state = AFTER_S if self.state == START and role[:1] == "s" else AFTER[self.state]
            yield role, text


_REPAIRED = pa.schema([*_AUDITED, ("repaired_sha256", pa.string())])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of repaired conversations; a conversation's audit stands before its rows."""

    def repaired():
        head = lines = digest = None
        some = False

        def write(new):
            nonlocal some
            for role, text in new:
                digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True

        for row in _streamed(batches):
            if row["audit"] is not None:
                if head:
                    write(lines.inserts())
                    yield *(head[c] for c in _AUDITED.names), digest.hexdigest()
                head, lines, digest, some = row, _Repairing(row["audit"]), hashlib.sha256(), False
            else:
                write(lines.row(row["role"], row["text"]))
        if head:
            write(lines.inserts())
            yield *(head[c] for c in _AUDITED.names), digest.hexdigest()

    yield from _row_batches(repaired(), _REPAIRED)


def repair(rows: DataFrame) -> DataFrame:
    """Every conversation's counts, cheapest repair and digest of what it leaves, of with_damage's rows (conv_id, turn, role, text, gone)."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "gone")
    signed = saved(signatures(rows))
    found = saved(audits(signed))
    forget(signed)
    texts = rows.where(~F.col("gone")).select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    lined = found.unionByName(texts, allowMissingColumns=True)
    order = ["conv_id", F.col("audit").isNull(), "turn", "role", "digest"]
    return lined.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repair, _AUDITED_DDL + ", repaired_sha256 string")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(with_damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES = {"op13_structure_repair": op13_structure_repair}
ORACLES: dict[str, str] = {}
