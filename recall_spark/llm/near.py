"""SimHash near-duplicates by pigeonhole blocks.

`near_groups`: a fingerprint has 64 bits. It is cut into `BLOCKS` blocks; two fingerprints that differ in at most `radius`
bits agree on at least BLOCKS - radius whole blocks, so they share the key of some choice of that many
blocks. Fingerprints are keyed once for every choice, keys are shuffled, and inside a key the true
distances are computed. A key emits the links of a spanning forest, not its pairs. A key with more than `CROWD`
fingerprints is cut again: of radius + 1 blocks of its other bits, close ones agree on one.

`similar_groups` links texts by the similarity of their shingle sets. A fingerprint of 64 bits can't tell similarities
of 0.8 by a few bits, so blocks come from the text: shingles are dealt to classes by their hash, and each class
gives a block. Texts of the similarity differ in few shingles, so some classes have none of them: the blocks agree.
There are as many classes as leave `AGREE` agreeing blocks on average at the least similarity. Inside a key the Hamming distances of
SimHash fingerprints of 128 bits choose a spanning forest, nearest first; the similarity of a link's shingle sets is then computed
from the texts, and links below the least go. This finds most links, not all: the rest is found without fail by prefixes. Shingles
have one order, by how many texts' hashes fall to their counter, rarest first. Sets of the similarity share one of their first shingles, so many as could all
be missing from the other. Sets of different groups that share one meet; a pair goes if the sets' sizes and the place of the first shared shingle, or the parities
of their shingles by bucket, rule the similarity out, and is else computed from the texts. The counters only choose the order: whatever they hold, no pair is lost.

Nulls and empty texts have fingerprint zero, or the empty set of shingles, and link like any other. A null doc_id is
larger than all others; a component without any doc_id has none. Repeated rows are kept. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, saved, slices, table, texts_of
from .components import components

SHINGLE, RADIUS, BLOCKS = 3, 3, 5
#: Fingerprints from which on a key is cut again.
CROWD = 2000
#: Blocks that agree on average at the least similarity; bits of 128 within which a key's fingerprints are linked.
AGREE, LINKED = 4, 30
#: Bits of a shingle's hash that name its counter.
COUNTER = 20
#: Pairs that a task gives at a time.
PAIRS = 1 << 18
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 bits (seed 42) of all word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _long(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _cut(bits: list[int], blocks: int) -> list[int]:
    """Bit masks of bits cut into blocks."""
    cuts = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks, as signed longs, of every choice of blocks - radius blocks."""
    return [_long(sum(chosen)) for chosen in combinations(_cut(list(range(64)), blocks), blocks - radius)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """mask with each of radius + 1 blocks of the other bits; itself if no bits are left to cut."""
    other = [b for b in range(64) if not mask >> b & 1]
    return [_long((mask & (1 << 64) - 1) | m) for m in _cut(other, radius + 1)] if len(other) > radius else [mask]


def _forest(fps: list[np.ndarray], ids: np.ndarray, radii: list[int]) -> tuple[list, list]:
    """Links that connect what lies within the last radius, among the fingerprints (64 bits each of fps) of one key; within smaller radii first."""
    k, ends_a, ends_b = len(ids), [], []
    root = np.arange(k)
    for radius in radii:
        for shift in range(1, k):
            if not root.any():
                return ends_a, ends_b  # all are connected
            distance = sum(np.bitwise_count(fp[shift:] ^ fp[:-shift]).astype(np.int16) for fp in fps)
            close = np.flatnonzero((distance <= radius) & (root[shift:] != root[:-shift]))
            a, b = root[close], root[close + shift]
            while len(close):
                fresh = np.unique(np.maximum(a, b), return_index=True)[1]  # one link for each root that is moved
                ends_a.append(ids[close[fresh]])
                ends_b.append(ids[close[fresh] + shift])
                root[np.maximum(a, b)[fresh]] = np.minimum(a, b)[fresh]
                while (root[root] != root).any():
                    root = root[root]
                a, b = root[close], root[close + shift]
                apart = a != b
                close, a, b = close[apart], a[apart], b[apart]
    return ends_a, ends_b


def _links(keys: list[str], fps: list[str], node: str, radii: list[int]):
    """Links (a, b) of the nodes of each key, over rows sorted by keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, *fps, node]
        held = [np.empty(0, np.int64) for _ in names]

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, ids = cols[: len(keys)], [x.view(np.uint64) for x in cols[len(keys) : -1]], cols[-1]
            ends_a, ends_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            change = np.zeros(max(len(ids) - 1, 0), bool)
            for x in key:
                change |= x[1:] != x[:-1]
            starts = np.flatnonzero(np.r_[True, change][: len(ids)])
            sizes = np.diff(np.r_[starts, len(ids)])
            two = starts[sizes == 2]
            two = two[sum(np.bitwise_count(x[two] ^ x[two + 1]).astype(np.int16) for x in fp) <= radii[-1]] if len(two) else two
            ends_a.append(ids[two])
            ends_b.append(ids[two + 1])
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                x, y = _forest([v[s : s + n] for v in fp], ids[s : s + n], radii)
                ends_a += x
                ends_b += y
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ends_a)), pa.array(np.concatenate(ends_b))], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([x, batch.column(n).to_numpy(zero_copy_only=False)]) for x, n in zip(held, names, strict=True)]
            other = np.zeros(len(held[0]), bool)
            for x in held[: len(keys)]:
                other |= x != x[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                yield out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield out(held)

    return run


def _split(keyed: DataFrame, radius: int, crowd: int) -> DataFrame:
    """keyed (m, key, fp) with crowded keys cut by further blocks until none is crowded or bits end."""
    spark, masks = keyed.sparkSession, None
    for _ in range(4):
        crowded = saved(keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("m", "key"))
        masks = [r.m for r in crowded.select("m").distinct().collect()]  # at most a row for each mask
        finer = [(m, x) for m in masks for x in finer_masks(m, radius) if x != m]
        if not finer:
            forget(crowded)
            return keyed
        table_ = F.broadcast(spark.createDataFrame(finer, "m long, x long"))
        cut = keyed.join(crowded, ["m", "key"], "left_semi").join(table_, "m").select(F.col("x").alias("m"), F.col("fp").bitwiseAND(F.col("x")).alias("key"), "fp")
        keyed = saved(keyed.join(crowded, ["m", "key"], "left_anti").union(cut))
        forget(crowded)
    return keyed


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links of at most radius differing bits."""
    fps = saved(fingerprints(docs, shingle))
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius, blocks)])
    keyed = nodes.select("fp", F.explode(masks).alias("m")).select("m", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    keyed = _split(keyed, radius, crowd).withColumn("node", F.col("fp"))
    links = keyed.repartition("m", "key").sortWithinPartitions("m", "key").mapInArrow(_links(["m", "key"], ["fp"], "node", [radius]), "a long, b long")
    lined = nodes.join(components(links), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = lined.groupBy("component").agg(F.min("rep").alias("component_id"))
    groups = lined.join(least, "component").select("fp", "component_id")
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")


class Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, size: int, known: Hashes) -> np.ndarray:
    """Sorted different hashes of the shingles of words (fewer words: the whole sequence)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _ODD + h[i : len(h) - k + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


@lru_cache(None)
def classes(n: int, similarity: float) -> int:
    """How many classes leave AGREE agreeing blocks on average to sets of n shingles of the similarity."""
    apart = 2 * (1 - similarity) / (1 + similarity) * n
    m = 1
    while m < n and m * np.exp(-apart / m) < AGREE:
        m += max(1, m // 16)
    return m


def block_keys(h: np.ndarray, similarity: float) -> list[int]:
    """Keys of the blocks of a set: for sets up to twice the next lower power of two in size, and for those below if they may be similar."""
    n = len(h)
    if not n:
        return [0]
    band = n.bit_length() - 1
    out: list[int] = []
    for k in (band, band - 1) if band and similarity * n < 1 << band else (band,):
        m = classes(2 << k, similarity)
        c = ((h >> np.uint64(20)) * _MIX >> np.uint64(32)) % np.uint64(m)
        by = np.argsort(c, kind="stable")
        own, c = h[by], c[by]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        block = np.add.reduceat((own ^ (own >> np.uint64(31))) * _ODD, first) + (c[first] + np.uint64(k << 20)) * _MIX
        out += ((block ^ (block >> np.uint64(32))) * _ODD).view(np.int64).tolist()
    return out


def _counted(shingle: int):
    """(slab, counts) of a task: how many shingles fall to each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Hashes(), np.zeros(1 << COUNTER, np.int64)
        for batch in slices(batches):
            known = known if len(known) < 500_000 else Hashes()
            found = np.concatenate([shingles(t, shingle, known) for t in texts_of(batch)])
            total += np.bincount((found >> np.uint64(64 - COUNTER)).view(np.int64), minlength=1 << COUNTER)
        for slab, part in enumerate(np.split(total, 16)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slab", "counts"])

    return run


def _added(got: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in got["counts"])
    return pa.table({"slab": got["slab"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def counters(texts: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of all texts by counter; tasks send 1 << COUNTER sums each, whatever the number of texts."""
    found = texts.select("text").coalesce(4 * texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(_counted(shingle), "slab int, counts binary")
    got = found.groupBy("slab").applyInArrow(_added, "slab int, counts binary").toArrow()
    out = np.zeros((16, (1 << COUNTER) // 16), np.int64)
    for slab, counts in zip(got["slab"].to_pylist(), got["counts"], strict=True):
        out[slab] = np.frombuffer(counts.as_buffer(), np.int64)
    return out.ravel()


def prefix(h: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rarest first: as many as can be missing from a set of the similarity, and one."""
    size = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
    return h[np.lexsort((h, counts[(h >> np.uint64(64 - COUNTER)).view(np.int64)]))[:size]]


def parities(h: np.ndarray) -> bytes:
    """A bit for each of as many buckets as the set has shingles (rounded up to a power of two): whether its number of shingles is odd."""
    size = max(8, 1 << (len(h) - 1).bit_length()) if len(h) else 8
    return np.packbits(np.bincount((h >> np.uint64(8) & np.uint64(size - 1)).view(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _sketches(shingle: int, similarity: float, shipped):
    """(doc_id, mark, node, fp, fp2, keys, n, first, odd): node names the set of n shingles; first is its prefix."""

    def votes(h: np.ndarray) -> int:
        total = np.zeros(64, np.int64)
        for start in range(0, len(h), 1 << 16):
            total += np.unpackbits(h[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = Hashes(), shipped.value
        for batch in slices(batches):
            known = known if len(known) < 500_000 else Hashes()
            sets = [shingles(t, shingle, known) for t in texts_of(batch)]
            fps = [[votes(h), votes(h * _MIX ^ (h * _MIX >> np.uint64(32)))] for h in sets]
            nodes = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            keys = pa.array([block_keys(h, similarity) for h in sets], pa.list_(pa.int64()))
            first = pa.array([prefix(h, similarity, counts).view(np.int64) for h in sets], pa.list_(pa.int64()))
            cols = {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "node": pa.array(nodes), **{c: pa.array([f[i] for f in fps], pa.int64()) for i, c in enumerate(("fp", "fp2"))}}
            yield pa.RecordBatch.from_pydict(cols | {"keys": keys, "n": pa.array([len(h) for h in sets], pa.int64()), "first": first, "odd": pa.array([parities(h) for h in sets], pa.binary())})

    return run


def _similar(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = Hashes()
            keep = []
            for s, t in zip(texts_of(batch, "text_a"), texts_of(batch, "text_b"), strict=True):
                x, y = shingles(s, shingle, known), shingles(t, shingle, known)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _pairs(similarity: float):
    """Pairs (a, b) of nodes of different groups that share a key, unless it can't be the first that sets of the similarity share. Rows come sorted by key and group."""
    names = ["key", "group", "node", "n", "at"]
    least = similarity / (1 + similarity)  # of both sizes together, shared

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, group, node, n, at = cols
        changes = key[1:] != key[:-1]
        left, a, b = n - at, [], []

        def ends(change: np.ndarray) -> np.ndarray:
            stop = np.r_[np.flatnonzero(change) + 1, len(key)]
            return np.repeat(stop, np.diff(np.r_[0, stop]))

        end, y = ends(changes), ends(changes | (group[1:] != group[:-1]))
        x = np.flatnonzero(y < end)
        y, end = y[x], end[x]
        while len(x):
            may = np.minimum(left[x], left[y]) >= least * (n[x] + n[y]) - 1e-6
            a.append(node[x[may]])
            b.append(node[y[may]])
            if sum(map(len, a)) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
            y = y + 1
            more = y < end
            x, y, end = x[more], y[more], end[more]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in names]
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, names, strict=True)]
            other = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else held[0]
            if len(other):
                cut = int(other[-1]) + 1
                yield from out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield from out(held)

    return run


def _may(similarity: float):
    """Pairs whose parities don't differ in more buckets than sets of the similarity have shingles that the other lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, s, t in zip(batch.column("n").to_pylist(), batch.column("odd_a"), batch.column("odd_b"), strict=True):
                x, y = sorted((np.frombuffer(v.as_buffer(), np.uint8) for v in (s, t)), key=len)
                while len(y) > len(x):  # the halves' buckets are one
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep.append(np.bitwise_count(x ^ y).sum(dtype=np.int64) <= (1 - similarity) / (1 + similarity) * n + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _checked(found: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the saved pairs (a, b) of nodes whose sets have the similarity, computed from the texts."""
    asked = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(nodes.select("node", "mark"), "node")
    one = saved(texts.join(asked, "mark").groupBy("node").agg(F.first("text").alias("text")))
    sides = found.join(one.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(one.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    links = saved(sides.mapInArrow(_similar(shingle, similarity), "a long, b long"))
    forget(one)
    return links


def _left_out(nodes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different groups (node, component) that may have the similarity: none that has it is missing."""
    own = nodes.select("node", "n", "first").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("group"), "n", F.posexplode("first").alias("at", "key"))
    keyed = own.select("key", "group", "node", "n", F.col("at").cast("long").alias("at")).repartition("key").sortWithinPartitions("key", "group")
    found = keyed.mapInArrow(_pairs(similarity), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))
    both = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "odd_a", "odd_b")
    return both.mapInArrow(_may(similarity), "a long, b long")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """(doc_id, mark, component): rows are linked, directly or over others, if their shingle sets have the similarity or more.

    mark is xxhash64 of the text; component names the group. Needs doc_id and text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    shipped = docs.sparkSession.sparkContext.broadcast(counters(texts, shingle))
    kind = "doc_id long, mark long, node long, fp long, fp2 long, keys array<long>, n long, first array<long>, odd binary"
    own = saved(texts.mapInArrow(_sketches(shingle, similarity, shipped), kind))
    nodes = saved(own.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "fp2", "keys", "n", "first", "odd")], F.min("mark").alias("mark")))
    keyed = nodes.select(F.explode("keys").alias("key"), "fp", "fp2", "node")
    crowded = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    # a crowded key is dealt by the other blocks of its texts: similar ones agree on some of them too
    again = keyed.join(crowded, "key", "left_semi").select("key", "node").join(nodes, "node").select("key", F.explode("keys").alias("other"), "fp", "fp2", "node").where("key <> other")
    keyed = keyed.join(crowded, "key", "left_anti").union(again.select(F.xxhash64("key", "other").alias("key"), "fp", "fp2", "node"))
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(["key"], ["fp", "fp2"], "node", [8, 14, 19, 24, LINKED]), "a long, b long")
    found = saved(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(crowded)
    links = _checked(found, texts, nodes, shingle, similarity)
    groups = components(links)
    rest = saved(_left_out(nodes, groups, similarity))
    more = _checked(rest, texts, nodes, shingle, similarity)
    if not more.isEmpty():
        groups = components(links.union(more))
    out = saved(own.select("doc_id", "mark", "node").join(groups, "node", "left").select("doc_id", "mark", F.coalesce("component", "node").alias("component")))
    for done in (own, nodes, found, rest, links, more):
        forget(done)
    shipped.unpersist()
    return out


def op3_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near": op3_simhash_near}
ORACLES: dict[str, str] = {}
