"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed, left to right, into the
longest phrases that occur in a language's text; the language that needs the fewest phrases, each costing
the bits that point at a place in its text, wins. Automata keep only the transitions there are, so their size is in
proportion to the text they learn from, whatever the alphabet.

Learning takes at most `DOCS` documents a language (those with the least hash of doc_id) and `SYMBOLS`
symbols of them, a bounded sample: from each document a span at a place that the hash of its doc_id chooses. Every text is
parsed whole. numpy walks pieces of `BLOCK` symbols of many texts at once; a piece whose predecessor ends within a phrase is walked
again from there until both walks agree, so pieces leave no trace in the result.

Symbols are lower-case letters; what lies between letters counts as one blank. Null texts and texts without a letter
are `und` with score 0, as is everything when there is nothing to learn from. Ties go to the first language
in alphabetical order. Rows that repeat are judged alike; documents without a doc_id are not learnt from, and not held out. Input
columns named as a result column are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, slices, table

DOCS, SYMBOLS, BLOCK, FOLDS, HELD_OUT = 64, 24_000, 512, 4, 2
BLANK, STRANGE = 0, 1
#: How often pieces are walked again side by side before those still left are walked in order.
ROUNDS = 3
RESULTS = ["lang_pred", "lang_score", "lang_fits"]


def _symbols(text: str, table_: np.ndarray) -> np.ndarray:
    """Symbol ids, runs of blanks as one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = table_[codes]
    keep = ids != BLANK
    keep[1:] |= ids[:-1] != BLANK
    return ids[keep]


def _automaton(ids: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ids; state 0 is the root, to which nothing leads."""
    length, link, step = [0], [-1], [{}]
    last = 0
    for c in ids:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class Parser:
    def __init__(self, texts: dict[str, list[str]]):
        """texts: of each language."""
        self.langs = sorted(texts)
        alphabet = sorted({c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha()})
        self.alphabet = "".join(alphabet)
        self.letters = len(alphabet) + 2
        tab = self.table()
        self.bits, self.roots, self.fresh = [], [], []
        only, to, keys, ends = [], [], [], []  # the one transition of a state, if it has one; transitions of others
        for lang in self.langs:
            ids: list[int] = []
            for t in texts[lang]:
                ids += [x for x in _symbols(t, tab).tolist() if x != STRANGE] + [BLANK]
            ids = ids[:SYMBOLS]
            root = len(only)
            steps = _automaton(ids)
            first = np.full(self.letters, root, np.int32)
            first[list(steps[0])] = [root + x for x in steps[0].values()]
            self.fresh.append(first)
            for step in steps:
                one = len(step) == 1
                if not one:
                    keys += [len(only) * self.letters + c for c in step]
                    ends += [root + x for x in step.values()]
                c, x = next(iter(step.items())) if one else (-1 if step else -2, 0)
                only.append(c)
                to.append(root + x)
            self.roots.append(root)
            self.bits.append(np.log2(len(ids) + 2))
        self.only, self.to = np.array(only, np.int32), np.array(to, np.int32)
        self.width = max(4, (4 * len(keys)).bit_length())  # of a hash table that is at most a quarter full
        self.keys, self.ends = np.full((1 << self.width) + len(keys), -1, np.int64), np.zeros((1 << self.width) + len(keys), np.int32)
        for key, slot, x in zip(keys, self.slots(np.array(keys, np.int64)).tolist(), ends, strict=True):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.ends[slot] = key, x

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.width)).astype(np.int64)

    def table(self) -> np.ndarray:
        """Symbol of every code point."""
        found = np.fromiter((STRANGE if chr(i).isalpha() else BLANK for i in range(0x110000)), np.int16, 0x110000)
        found[[ord(c) for c in self.alphabet]] = np.arange(2, self.letters)
        return found

    def step(self, k: int, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state behind symbols c in language k, whether a phrase starts with them)."""
        one = self.only[state]
        to = np.where(one == c, self.to[state], -1)
        many = np.flatnonzero(one == -1)
        if len(many):
            key = state[many].astype(np.int64) * self.letters + c[many]
            slot = self.slots(key)
            found = self.keys[slot]
            while len(off := np.flatnonzero((found != key) & (found >= 0))):
                slot[off] += 1
                found[off] = self.keys[slot[off]]
            to[many] = np.where(found == key, self.ends[slot], -1)
        starts = (to < 0) | (state == self.roots[k])
        return np.where(to < 0, self.fresh[k][c], to).astype(np.int32), starts

    def _walk(self, k: int, state: int, symbols: list[int], trace: np.ndarray, starts: np.ndarray) -> None:
        """Walks one piece from a state until it agrees with its trace, which it corrects."""
        root, fresh = self.roots[k], self.fresh[k]
        for j, c in enumerate(symbols):
            one, to = self.only.item(state), -1
            if one == c:
                to = self.to.item(state)
            elif one == -1:
                key = state * self.letters + c
                slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.width)
                while (found := self.keys.item(slot)) not in (key, -1):
                    slot += 1
                to = self.ends.item(slot) if found == key else -1
            starts[j] = to < 0 or state == root
            state = fresh.item(c) if to < 0 else to
            if trace.item(j) == state:
                return
            trace[j] = state

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each language needs for each text."""
        blocks = [-(-len(x) // BLOCK) for x in parts]
        owner = np.repeat(np.arange(len(parts)), blocks)
        laid = np.zeros((len(owner), BLOCK), np.int16)
        full = np.zeros(len(owner), np.int64)
        at = 0
        for x, n in zip(parts, blocks, strict=True):
            laid[at : at + n].reshape(-1)[: len(x)] = x
            full[at : at + n] = np.minimum(BLOCK, len(x) - BLOCK * np.arange(n))
            at += n
        order = np.argsort(-full, kind="stable")  # the blocks still going are always the first ones
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        inner = np.flatnonzero(np.r_[False, owner[1:] == owner[:-1]])  # blocks with one before them
        this, before = place[inner], place[inner - 1]
        laid, full, owner = np.ascontiguousarray(laid[order].T), full[order], owner[order]
        out = np.zeros((len(parts), len(self.langs)), np.int64)
        if not len(full):
            return out
        going = [int(np.searchsorted(-full, -j, side="left")) for j in range(int(full[0]))]
        trace, starts = np.zeros(laid.shape, np.int32), np.zeros(laid.shape, bool)
        for k, root in enumerate(self.roots):
            state = np.full(len(full), root, np.int32)
            for j, live in enumerate(going):
                state[:live], starts[j, :live] = self.step(k, state[:live], laid[j, :live])
                trace[j, :live] = state[:live]
            entered = np.full(len(full), root, np.int32)
            for _ in range(ROUNDS):
                leaves = trace[full[before] - 1, before]
                late = leaves != entered[this]
                cur, now, j = this[late], leaves[late], 0
                entered[cur] = now
                while len(cur):
                    now, starts[j, cur] = self.step(k, now, laid[j, cur])
                    on = (trace[j, cur] != now) & (full[cur] > j + 1)
                    trace[j, cur] = now
                    cur, now, j = cur[on], now[on], j + 1
            late = trace[full[before] - 1, before] != entered[this]
            if late.any():  # phrases longer than pieces: the rest of these texts is walked in order
                texts = np.isin(owner[this], owner[this[late]])
                for x, b in zip(before[texts].tolist(), this[texts].tolist(), strict=True):
                    if (now := trace.item(int(full[x]) - 1, x)) != entered[b]:
                        entered[b] = now
                        self._walk(k, now, laid[: full[b], b].tolist(), trace[:, b], starts[:, b])
            out[:, k] = np.bincount(owner, starts.sum(axis=0), minlength=len(parts))
        return out

    def costs(self, parts: list[np.ndarray]) -> np.ndarray:
        """Bits per symbol that each language needs, for each text."""
        return self.phrases(parts) * np.array(self.bits) / np.maximum(1, [[len(x)] for x in parts])


def _sample(docs: DataFrame) -> dict[str, list[str]]:
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(crc_mod(FOLDS) != HELD_OUT)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    near = known.join(F.broadcast(counts), "lang").withColumn("h", F.xxhash64("doc_id")).where(F.pmod("h", F.lit(1 << 30)) < F.lit(2.0 * DOCS) / F.col("n") * (1 << 30))
    first = near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("i") <= DOCS)
    size = (SYMBOLS / F.least("n", F.lit(DOCS))).cast("int")
    place = (F.pmod(F.xxhash64("doc_id", F.lit("span")), F.greatest(F.length("text") - size, F.lit(0)) + 1) + 1).cast("int")
    texts: dict[str, list[str]] = {}
    for r in first.select("lang", "i", F.substring(F.col("text"), place, size).alias("t")).orderBy("lang", "i").collect():  # at most DOCS rows and about SYMBOLS characters a language
        texts.setdefault(r.lang, []).append(r.t)
    return {k: v for k, v in texts.items() if any(c.isalpha() for t in v for c in t)}


def languages(docs: DataFrame) -> DataFrame:
    """All columns of docs, lang_pred, lang_score and lang_fits. Needs doc_id, text and lang; lang is read for learning only.

    lang_fits says whether the language's text helps to write the text down: its phrases cost fewer bits than single
    symbols would. It is false for `und`, and null where there is nothing to learn from.
    """
    parser = Parser(_sample(docs.select("doc_id", "text", "lang")))
    docs = docs.drop(*RESULTS)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(None).cast("boolean").alias("lang_fits")).schema
    shipped = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, tab = shipped.value, None
        for batch in slices(batches):
            tab = p.table() if tab is None else tab
            parts = [_symbols(t or "", tab) for t in batch.column("text").to_pylist()]
            named = [bool((x > BLANK).any()) and bool(p.langs) for x in parts]
            preds, scores, fits = ["und"] * len(parts), [0.0] * len(parts), [False if p.langs else None] * len(parts)
            if p.langs:
                costs = p.costs(parts)
                best = costs.argmin(axis=1)
                least = costs.min(axis=1, keepdims=True)
                score = 1 / np.exp(-4 * (costs - least)).sum(axis=1)
                for i in np.flatnonzero(named):
                    preds[i], scores[i], fits[i] = p.langs[best[i]], float(score[i]), bool(least[i, 0] < np.log2(p.letters))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.coalesce(crc_mod(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
