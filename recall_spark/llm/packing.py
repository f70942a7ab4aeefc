"""Mixture-controlled packing by deficit round-robin over source queues.

Documents become token ids with an end id behind. A source's documents, laid end to end, are dealt to blocks of bounded
size in proportion to the target, whatever the order of the table; a document may be split between blocks. While all
sources have tokens, each block holds the target shares; as soon as one has none left, the others share what it had, in
further blocks. In a block each source has a queue; every window of `SEQUENCE` tokens credits each source with its share
of the block, serves sources while their credit lasts and carries what is left, credit or debt, to the next window. A
block's last window, if short, is cut into powers of two and needs no padding.

Shares are the sources' shares of all tokens unless given. Null text is empty (its end id remains); a null source
is a source of its own. Rows repeat as often as they come. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import saved, slices, table

SEQUENCE, END, QUANTUM = 1024, 0, 16
#: Tokens of a block, at most, and at least if there are as many blocks as input partitions.
BLOCK_TOKENS, LEAST_TOKENS = 1 << 22, 1 << 16
_COMMON = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")


class ByteEncoder:
    """ids of whole texts for a byte-level BPE.

    Texts of common characters go to the faster of two libraries with the same vocabulary; texts with other
    characters, whose classes the two might see differently, and texts that hold a special token go to the other.
    """

    def __init__(self, path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 16-bit integers."""
        if _COMMON.fullmatch(text) and not any(x in text for x in self.special):
            return array("H", self.fast(text)).tobytes()
        return array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


def tokens_of(docs: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, source, part, before, n, ids): before counts the source's tokens before in the partition; ids are 16-bit and end with END."""
    path, ranks_path = path or vocabulary("byte_bpe_50k.json"), ranks_path or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, held = None, TaskContext.get().partitionId(), {}
        end = array("H", [END]).tobytes()
        for batch in slices(batches):
            enc = enc or ByteEncoder(path, ranks_path)
            ids = [enc.encode(t or "") + end for t in batch.column("text").to_pylist()]
            before = []
            for s, x in zip(batch.column("source").to_pylist(), ids, strict=True):
                before.append(held.get(s, 0))
                held[s] = before[-1] + len(x) // 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "part", "before", "n", "ids"])

    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), "text").mapInArrow(run, "doc_id long, source string, part long, before long, n long, ids binary")


def schedule(sizes: dict[str, int], shares: dict[str, float], block_tokens: int) -> dict[str, list[tuple[int, int, int, int]]]:
    """For each source its phases (first token, tokens, first block, blocks); a phase ends when a source of the target has no tokens left."""
    left, out, block = {s: n for s, n in sizes.items() if n}, {s: [] for s in sizes}, 0
    while left:
        rates = {s: shares[s] for s in left if shares.get(s, 0.0) > 0} or dict(left)
        last = min(rates, key=lambda s: (left[s] / rates[s], s))
        length = left[last] / rates[last]
        take = {s: left[s] if s == last or left[s] - r * length < 1 else int(r * length) for s, r in rates.items()}
        blocks = max(1, -(-sum(take.values()) // block_tokens))
        for s, n in take.items():
            if n:
                out[s].append((sizes[s] - left[s], n, block, blocks))
                left[s] -= n
        left = {s: n for s, n in left.items() if n}
        block += blocks
    return out


def spans(phases: list[tuple[int, int, int, int]], at: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(block, start, length) of the pieces of a document whose first token is its source's token number at."""
    x, end = at, at + n
    k = bisect_right(phases, at, key=lambda p: p[0]) - 1
    while x < end:
        first, size, block, blocks = phases[k]
        j = (blocks * (x - first + 1) - 1) // size
        stop = min(end, first + size * (j + 1) // blocks)
        yield block + j, x - at, stop - x
        x = stop
        k += x == first + size


def _deal(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "block", "at", "start", "n", "doc_tokens", "ids"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, s, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "at", "n", "ids")), strict=True):
                for block, start, length in spans(shipped.value[s], at, n):
                    for col, x in zip(out, (doc, s, block, at + start, start, length, n, ids[2 * start : 2 * (start + length)]), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def fill(queues: dict[str, list], shares: dict[str, float], owed: dict[str, float], sequence: int = SEQUENCE) -> Iterator[list]:
    """Windows, each a list of (document, start, length). queues: source -> [(document, n tokens), ...]."""
    names = sorted(queues)
    left = {s: sum(n for _, n in queues[s]) for s in names}
    at = {s: [0, 0] for s in names}  # document, token
    credit = {s: owed.get(s, 0.0) for s in names}

    def serve(s: str, want: int, window: list) -> None:
        queue, pos = queues[s], at[s]
        left[s] -= want
        credit[s] -= want
        while want:
            doc, n = queue[pos[0]]
            take = min(n - pos[1], want)
            window.append((doc, pos[1], take))
            want -= take
            pos[1] += take
            if pos[1] == n:
                pos[0], pos[1] = pos[0] + 1, 0

    total = sum(left.values())
    while total:
        window: list = []
        room = size = min(sequence, total)
        live = [s for s in names if left[s]]
        for s in live:
            credit[s] += shares.get(s, 0.0) * size
        live.sort(key=credit.__getitem__, reverse=True)
        for s in live:
            take = min(int(credit[s]), left[s], room) if credit[s] >= 1 else 0
            if take and (take >= QUANTUM or take == left[s] or take == room):
                serve(s, take, window)
                room -= take
        while room:  # what shares and rounding leave: the source that is owed most
            s = max((s for s in live if left[s]), key=credit.__getitem__)
            take = min(left[s], room)
            serve(s, take, window)
            room -= take
        total -= size
        yield window


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(sequence: int):
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(got: pa.Table) -> pa.Table:
        got = got.sort_by([("source", "ascending"), ("at", "ascending")])
        block = got["block"][0].as_py()
        ids, docs, sizes, starts, whole = (got[c].to_pylist() for c in ("ids", "doc_id", "n", "start", "doc_tokens"))
        queues: dict[str, list] = {}
        for i, (s, n) in enumerate(zip(got["source"].to_pylist(), sizes, strict=True)):
            queues.setdefault(s, []).append((i, n))
        shares = {s: sum(n for _, n in q) / sum(sizes) for s, q in queues.items()}
        seq = block << 20
        out: list[list] = [[] for _ in fields]

        def put(i: int, start: int, length: int, seq: int, offset: int) -> None:
            raw = np.frombuffer(ids[i], "<u2", length, 2 * start).astype("<u4").tobytes()
            for col, x in zip(out, (docs[i], starts[i] + start, length, zlib.crc32(raw), whole[i], seq, offset), strict=True):
                col.append(x)

        for window in fill(queues, shares, {}, sequence):
            size = sum(x[2] for x in window)
            ends = [sequence] if size == sequence else np.cumsum(powers(size)).tolist()
            offset, k, begun = 0, 0, 0
            for i, start, length in window:
                while length:
                    take = min(length, ends[k] - offset)
                    put(i, start, take, seq, offset - begun)
                    start, length, offset = start + take, length - take, offset + take
                    if offset == ends[k]:
                        k, begun, seq = k + 1, offset, seq + 1
        return pa.table(dict(zip(fields, (pa.array(c, pa.int64()) for c in out), strict=True)))

    return run


def pack(docs: DataFrame, mixture: dict[str, float] | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of documents with doc_id, text and source.

    mixture: target shares by source, which are scaled to one; sources that it lacks fill what is left. The
    table of sums has a row for each input partition and source.
    """
    tokens = saved(tokens_of(docs))
    sums = saved(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")))
    sizes = {r.source: r.n for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    shares = {s: float(n) for s, n in sizes.items()} if mixture is None else {"=" + k: v for k, v in mixture.items()}
    total, parts = sum(sizes.values()), sums.select("part").distinct().count()
    phases = schedule(sizes, shares, min(BLOCK_TOKENS, max(LEAST_TOKENS, -(-total // max(parts, 1)))))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(base, ["part", "source"]).select("doc_id", "source", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    dealt = placed.mapInArrow(_deal(docs.sparkSession.sparkContext.broadcast(phases)), "doc_id long, source string, block long, at long, start long, n long, doc_tokens long, ids binary")
    return dealt.groupBy("block").applyInArrow(_pack(sequence), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
