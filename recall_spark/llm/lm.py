"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class, history). The most frequent words are classes of
their own, other words fall into classes by their ending. A class is scored by a softmax over features of the history
(the word before, the word before that, both, and a skip feature that only says which words stand there), hashed into
a table of weights. Within a class the bits of a word's hash are decisions of a binary tree, each scored by the word
before and the skip over it to the one before that, hashed into a second table (both words at once are too rare there
and lose held-out likelihood); a part of the tree that training has seen less than `Model.least` times is not
decided further, and a word has its smoothed share of it. Without weights the model is exactly the smoothed unigram
model; a word that training lacks always costs what it costs there.

Weights are trained by one update over all training documents, that of generalised iterative scaling from the model without
weights: tasks sum what is observed and what the model expects, the sums are added up by a shuffle on slabs of weight rows, and each
weight moves by `STEP` of the log ratio of the two. A second pass, for which every token needs its softmax, costs more than
twice the first and is left out. Tables, classes and decisions grow with the training tokens. Counts are over all training documents too: words are counted by a shuffle,
and each block of documents gets back the counts of just its own words.

Null and empty texts are the end token alone. Rows that repeat a doc_id are scored each; a null doc_id belongs to
training. With no training tokens every token costs log10(1 / 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, let_go, saved, slices, table

FOLDS, HELD_OUT = 7, 2
CHUNK, STEP = 1 << 13, 0.6
#: Tokens whose softmax is worked out at a time, so that it stays in a core's cache.
PIECE = 1 << 10
#: Words whose decisions are found at a time, words that training looks up before it begins anew, and bytes of text whose tokens are numbered at a time.
WORDS, KEPT_WORDS, PIECE_BYTES = 1 << 16, 1 << 17, 1 << 21
#: How many of a token's features decisions use: the word before, and the one before that alone.
SPLIT_FEATURES = 2
#: Events at which what a weight row has seen counts as much as what the model says without it.
STEADY = 40.0
#: Bits of a word's hash that decisions may use, and those by which words are dealt to count them; bytes of weights, about, that one row of partial sums carries.
DEPTH, WHOLE, SLAB = 24, 6, 1 << 18
END = b""
#: Text of a block, about, in characters.
BLOCK = 12_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-case words and the end."""
    return [*text.lower().split(), END]


def dealt(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words of a string column end to end, where each stands among the tokens, and how many tokens each text has; the last token of a text is its end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.list_flatten(split)
    full = pc.greater(pc.binary_length(words), 0)
    owner = pc.list_parent_indices(split).filter(full).to_numpy(zero_copy_only=False)
    sizes = np.bincount(owner, minlength=len(texts)) + 1
    return words.filter(full).cast(pa.binary()), np.arange(len(owner)) + owner, sizes


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, n): how often a word occurs in the training documents of a block; words of other documents with 0. Rows come sorted by block."""
    at, held = None, {True: [], False: []}

    def out() -> pa.RecordBatch:
        own = pa.chunked_array(held[True], pa.binary()).value_counts()
        words, n = own.field("values"), own.field("counts").to_numpy()
        other = pa.chunked_array(held[False], pa.binary()).unique()
        other = other.filter(pc.invert(pc.is_in(other, value_set=words)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words) + len(other), at, np.int64)), pa.concat_arrays([words, other]), pa.array(np.r_[n, np.zeros(len(other), np.int64)])], names=["block", "word", "n"])

    for batch in slices(batches):
        block, train = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("block", "train"))
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if block[start] != at:
                if at is not None:
                    yield out()
                at, held = block[start], {True: [], False: []}
            for fold in (True, False):
                rows = np.flatnonzero(train[start:stop] == fold) + start
                if len(rows):
                    held[fold] += [dealt(batch.column("text").take(pa.array(rows)))[0], pa.array([END], pa.binary()).take(pa.array(np.zeros(len(rows), np.int64)))]
    if at is not None:
        yield out()


class Model:
    def __init__(self, top: list[bytes], endings: int, vocab: int, total: int):
        grown = math.log2(total + 1)
        self.top, self.endings, self.classes = top, endings, len(top) + endings
        own = hashes(top)
        self.top_classes = np.argsort(own)
        self.top_hashes = own[self.top_classes]
        self.norm = total + vocab + 1.0  # smoothed mass of all words, with one unknown
        self.least = max(8.0, math.sqrt(total) / 8)
        self.bits, self.split_bits = max(13, round(3 + 0.42 * grown)), max(16, round(10 + 0.4 * grown))
        self.mass = np.full(self.classes, 1e-9)
        self.decide(np.empty(0, np.int64), np.empty(0, np.float32))
        self.weights = np.zeros((1 << self.bits, self.classes), np.float32)
        self.splits = np.zeros(1 << self.split_bits, np.float32)

    @staticmethod
    def sizes(total: int) -> tuple[int, int]:
        """How many words are classes of their own, and how many classes of endings there are."""
        grown = max(1.0, (total / (1 << 24)) ** (1 / 6))
        return round(24 * grown), round(40 * grown)

    def classes_of(self, words: list[bytes], h: np.ndarray) -> np.ndarray:
        """Classes of words with hashes h: a frequent word's own, else one of the last three bytes."""
        if not words:
            return np.empty(0, np.int64)
        raw = np.frombuffer(b"\0\0\0" + b"".join(words), np.uint8).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size) + 3
        tail = np.zeros(len(words), np.uint64)
        for i in range(3):
            tail = tail * np.uint64(257) + np.where(size > i, raw[end - 1 - i] + np.uint64(1), 0)
        out = len(self.top) + ((tail * _MIX >> np.uint64(33)) % np.uint64(max(self.endings, 1))).astype(np.int64)
        if len(self.top):
            i = np.minimum(np.searchsorted(self.top_hashes, h), len(self.top) - 1)
            out = np.where(self.top_hashes[i] == h, self.top_classes[i], out)
        return out

    def decide(self, nodes: np.ndarray, odds: np.ndarray) -> None:
        """Sets which nodes of the tree are decisions, in order, and their log odds; a node holds a run of places (places)."""
        self.nodes, self.odds, self.node_hashes = nodes, odds, nodes.view(np.uint64) * _MIX
        below = nodes & ((1 << 32) - 1)
        self.depths = np.frexp(below.astype(float))[1].astype(np.int64) - 1
        self.deepest = int(self.depths.max(initial=-1)) + 1
        self.first = ((nodes >> 32) << DEPTH) + ((below ^ (1 << self.depths)) << (DEPTH - self.depths))
        self.last = self.first + (1 << (DEPTH - self.depths))

    @property
    def prior(self) -> np.ndarray:
        return np.log(self.mass / self.norm).astype(np.float32)

    @staticmethod
    def features(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Hashes of the features of tokens, from the hashes of the word before and the one before that."""
        skip = np.minimum(a, b) ^ (np.maximum(a, b) >> np.uint64(1))
        return [((x + np.uint64(k)) * _MIX ^ (x >> np.uint64(31))) * _MIX for k, x in enumerate((a, b, a * _MIX + b, skip))]

    def rows(self, mixed: list[np.ndarray]) -> list[np.ndarray]:
        return [(x >> np.uint64(64 - self.bits)).view(np.int64) for x in mixed]

    def paths(self, classes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Decisions that lead to words: how many each has; their nodes and whether they were taken, laid end to end; where each word's begin."""
        some = [self._some_paths(classes[i : i + WORDS], h[i : i + WORDS]) for i in range(0, max(len(h), 1), WORDS)]
        n, nodes, taken = (np.concatenate(x) for x in zip(*some, strict=True))
        return n, nodes, taken, np.cumsum(n) - n

    def _some_paths(self, classes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths of words without where they begin. Words in order of their places are runs of nodes, so nodes are looked for among words."""
        place = places(classes, h)
        order = np.argsort(place)
        place = place[order]
        start = np.searchsorted(place, self.first)
        held = np.searchsorted(place, self.last) - start
        own = order[np.arange(held.sum()) - np.repeat(np.cumsum(held) - held - start, held)]
        at = np.full((len(h), self.deepest), -1, np.int32)
        at[own, np.repeat(self.depths, held)] = np.repeat(np.arange(len(held), dtype=np.int32), held)
        found = at >= 0
        n, nodes = found.sum(axis=1), at[found].astype(np.int64)
        taken = (np.repeat(h, n) >> (63 - self.depths[nodes]).astype(np.uint64)) & np.uint64(1)
        return n, nodes, taken.astype(bool)

    def decisions(self, mixed: list[np.ndarray], words: np.ndarray, paths: tuple) -> tuple:
        """(token, taken, bins, node) of every decision of tokens."""
        n, nodes, bits, starts = paths
        each = n[words]
        token = np.repeat(np.arange(len(words)), each)
        at = np.arange(len(token)) + np.repeat(starts[words] - (np.cumsum(each) - each), each)
        node = nodes.take(at)
        own, shift = self.node_hashes.take(node), np.uint64(64 - self.split_bits)
        bins = []
        for x in mixed[:SPLIT_FEATURES]:
            bin_ = np.repeat(x, each)
            bin_ ^= own
            bin_ *= _MIX
            bin_ >>= shift
            bins.append(bin_.view(np.int64))
        return token, bits.take(at), bins, node

    def log_odds(self, bins: list[np.ndarray], node: np.ndarray) -> np.ndarray:
        z = self.odds.take(node)
        for x in bins:
            z += self.splits.take(x)
        return z

    def log_class(self, rows: list[np.ndarray], prior: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log share of classes y. A weight is at most STEP times the log of one over its class's share, so that no power overflows."""
        out, one = np.empty(len(y), np.float32), np.ones(self.classes, np.float32)
        z, more = np.empty((2, min(PIECE, len(y)), self.classes), np.float32)
        for at in range(0, len(y), PIECE):
            n = min(PIECE, len(y) - at)
            z, more = z[:n], more[:n]
            self.weights.take(rows[0][at : at + n], axis=0, out=z, mode="clip")  # rows are within the table; clip needs no copy of out
            for r in rows[1:]:
                z += self.weights.take(r[at : at + n], axis=0, out=more, mode="clip")
            z += prior
            own = z[np.arange(n), y[at : at + n]]
            out[at : at + n] = own - np.log(np.exp(z, out=z) @ one)
        return out


def places(classes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where words stand at the bottom of the tree: class, then DEPTH bits."""
    return (classes << DEPTH) | (h >> np.uint64(64 - DEPTH)).astype(np.int64)


def node_keys(classes: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Node of the tree in which words stand after so many bits."""
    prefix = (h >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(h), np.int64)
    return (classes << 32) | (1 << depth) | prefix


def lined(words: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the word before each word of texts of so many tokens, laid end to end, and of the one before that, 0 outside its text."""
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own, zero = h[words], np.zeros(2, np.uint64)
    return np.where(at > 0, np.r_[zero[:1], own[:-1]], 0).astype(np.uint64), np.where(at > 1, np.r_[zero, own[:-2]][: len(own)], 0).astype(np.uint64)


def listed(words: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """to_pylist, without an object for each scalar."""
    return (words.to_numpy(zero_copy_only=False) if isinstance(words, pa.Array) else words.to_numpy()).tolist()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Words:
    """Numbers of words, and what the model says of each, looked up once. The end is number 0."""

    def __init__(self, model: Model):
        self.model, self.known = model, pa.array([], pa.binary())
        self.h, self.classes, self.paths = np.empty(0, np.uint64), np.empty(0, np.int64), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        self.learn(pa.array([END], pa.binary()))

    def learn(self, fresh: pa.Array) -> None:
        words = listed(fresh)
        h = hashes(words)
        classes = self.model.classes_of(words, h)
        *paths, starts = self.model.paths(classes, h)
        self.paths = tuple(np.concatenate(x) for x in zip(self.paths, (*paths, starts + len(self.paths[1])), strict=True))
        self.h, self.classes, self.known = np.r_[self.h, h], np.r_[self.classes, classes], pa.concat_arrays([self.known, fresh])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of texts end to end, and how many each text has."""
        words, at, sizes = dealt(texts)
        own = pc.index_in(words, value_set=self.known)
        if own.null_count:
            new = words.filter(own.is_null())
            fresh = new.unique()
            found = np.array(own.fill_null(-1))
            found[found < 0] = len(self.known) + pc.index_in(new, value_set=fresh).to_numpy()
            self.learn(fresh)
        else:
            found = own.to_numpy()
        out = np.zeros(sizes.sum(), np.int64)
        out[at] = found
        return out, sizes


def parts(ids: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts (ids, sizes), some `least` tokens at a time; a longer text is a part of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        first = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, first + least, "right")))
        yield ids[first : ends[stop - 1]], sizes[start:stop]
        start = stop


def _sums(shipped):
    """Partial sums of a task, (kind, slab, sums): observed and expected weights of rows of classes (0) and of decisions (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        words = Words(m)
        seen, rows_seen = np.zeros(m.weights.size, np.int32), np.zeros(1 << m.bits, np.int32)
        taken, split = np.zeros(2 << m.split_bits, np.int32), np.zeros(1 << m.split_bits)  # not taken and taken, side by side; expected to be
        one = np.int32(1)
        chance = 1 / (1 + np.exp(-m.odds.astype(float)))

        def add(ids: np.ndarray, sizes: np.ndarray) -> None:
            a, b = lined(ids, sizes, words.h)
            for at in range(0, len(ids), CHUNK):  # in a core's cache
                own = ids[at : at + CHUNK]
                mixed, y = m.features(a[at : at + CHUNK], b[at : at + CHUNK]), words.classes[own]
                for row in m.rows(mixed):
                    np.add.at(rows_seen, row, one)
                    np.add.at(seen, row * m.classes + y, one)
                _, bit, bins, node = m.decisions(mixed, own, words.paths)
                p = chance.take(node)
                for x in bins:
                    np.add.at(split, x, p)
                    x <<= 1
                    x |= bit
                    np.add.at(taken, x, one)

        for batch in slices(batches, most=PIECE_BYTES):
            for part in parts(*words.ids(batch.column("text")), 1 << 16):
                add(*part)
            if len(words.known) > KEPT_WORDS:
                words = None  # goes before the next is made
                words = Words(m)
            pa.default_memory_pool().release_unused()
        words = None
        step = max(1, SLAB // m.classes)
        seen = seen.reshape(-1, m.classes)
        for i in range(0, 1 << m.bits, step):
            if rows_seen[i : i + step].any():
                yield _sum_row(0, i, seen[i : i + step], rows_seen[i : i + step])
        for i in range(0, 1 << m.split_bits, SLAB):
            own = taken[2 * i : 2 * (i + SLAB)].reshape(-1, 2)
            if own.any():
                yield _sum_row(1, i, own[:, 1].copy(), split[i : i + SLAB].astype(np.float32), own.sum(axis=1, dtype=np.int32))

    return run


def _sum_row(kind: int, slab: int, *sums: np.ndarray) -> pa.RecordBatch:
    """Counts, or sums of chances, of 4 bytes each: all first bytes, then all second bytes and so on, so that the shuffle's compression finds the zeros."""
    planes = np.concatenate([x.ravel().view(np.uint8).reshape(-1, 4) for x in sums]).T
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([slab], pa.int64()), pa.array([planes.tobytes()], pa.binary())], names=["kind", "slab", "sums"])


def _whole(sums: bytes | pa.Buffer, kind: int) -> np.ndarray:
    """What _sum_row put in, as float64: of decisions the middle third are chances."""
    planes = np.frombuffer(sums, np.uint8).reshape(4, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1)
    counts = values.view(np.int32).astype(float)
    if kind:
        third = len(counts) // 3
        counts[third : 2 * third] = values.view(np.float32)[third : 2 * third]
    return counts


def _moves(shipped):
    """What a slab's weights gain from the sums of all tasks."""

    def run(got: pa.Table) -> pa.Table:
        m, kind, slab = shipped.value, got["kind"][0].as_py(), got["slab"][0].as_py()
        total = sum(_whole(x.as_buffer(), kind) for x in got["sums"])
        if kind:
            taken, meant, n = total.reshape(3, -1)
            p = np.clip(meant / np.maximum(n, 1), 1e-6, 1 - 1e-6)
            move = np.where(n > 0, np.log((taken + STEADY * p) / (n - taken + STEADY * (1 - p))) - np.log(p / (1 - p)), 0)
        else:
            q = m.mass / m.mass.sum()
            count = min(max(1, SLAB // m.classes), (1 << m.bits) - slab)
            seen, meant = total[: count * m.classes].reshape(count, -1), total[count * m.classes :].reshape(count, -1) * q
            move = np.log((seen + STEADY * q) / (meant + STEADY * q))
        return pa.table({"kind": pa.array([kind], pa.int32()), "slab": pa.array([slab], pa.int64()), "move": pa.array([(move.ravel() * STEP).astype(np.float32).tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, model: Model) -> Model:
    """The update over all of docs (text), as one distributed sum, of which a task gives one partial sum a slab."""
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(model)
    sums = docs.coalesce(4 * sc.defaultParallelism).mapInArrow(_sums(shipped), "kind int, slab long, sums binary")
    got = sums.groupBy("kind", "slab").applyInArrow(_moves(shipped), "kind int, slab long, move binary").toArrow()  # one table of weights
    for kind, slab, move in zip(*(got[c] for c in ("kind", "slab", "move")), strict=True):
        flat, x = (model.splits if kind.as_py() else model.weights.reshape(-1)), np.frombuffer(move.as_buffer(), np.float32)
        at = slab.as_py() * (1 if kind.as_py() else model.classes)
        flat[at : at + len(x)] += x
    shipped.unpersist()
    del sums, got
    let_go(docs.sparkSession)
    return model


def _placed(shipped, parts: int):
    """(part, class, h, mass) of words: words that share a class and the first WHOLE bits of their hash share a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            words = listed(batch.column("word"))
            h = hashes(words)
            classes = m.classes_of(words, h)
            part = ((((classes.astype(np.uint64) << np.uint64(WHOLE)) | (h >> np.uint64(64 - WHOLE))) * _MIX >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(classes), pa.array(h.view(np.int64)), pa.array(batch.column("c").to_numpy() + 1.0)], names=["part", "class", "h", "mass"])

    return run


def _node_mass(least: float):
    """(node, mass, ones) of a part: smoothed mass of the words of a node, and of those whose next bit is 1; nodes from WHOLE bits on are whole, and only decisions stay."""

    def run(got: pa.Table) -> pa.Table:
        classes, h, mass = got["class"].to_numpy(), got["h"].to_numpy().view(np.uint64), got["mass"].to_numpy()
        out = []
        for d in range(DEPTH):
            key, at = np.unique(node_keys(classes, h, d), return_inverse=True)
            bit = ((h >> np.uint64(63 - d)) & np.uint64(1)).astype(float)
            all_, ones = np.bincount(at, mass, len(key)), np.bincount(at, mass * bit, len(key))
            if d >= WHOLE:
                heavy = all_ >= least  # no node below a light one is heavy
                on = heavy[at]
                classes, h, mass = classes[on], h[on], mass[on]
                keep = heavy & (ones > 0) & (ones < all_)
                key, all_, ones = key[keep], all_[keep], ones[keep]
            out.append((key, all_, ones))
        return pa.table(dict(zip(("node", "mass", "ones"), (pa.array(np.concatenate(x)) for x in zip(*out, strict=True)), strict=True)))

    return run


def _score(shipped, total: int):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        m = shipped.value
        prior = m.prior
        known_words = words["word"].combine_chunks()
        names = listed(known_words)
        c = words["c"].to_numpy().astype(float)
        h = hashes(names)
        classes, n_words = m.classes_of(names, h), len(names)
        del names
        n_paths, nodes, bits, _ = paths = m.paths(classes, h)
        base = np.log((c + 1) / m.norm)
        # of a word in the part of its class where decisions end
        odds = m.odds.astype(float)
        taken = np.r_[-np.logaddexp(0, odds), -np.logaddexp(0, -odds)].take(nodes + len(odds) * bits)
        share = np.log((c + 1) / m.mass[classes]) - np.bincount(np.repeat(np.arange(n_words), n_paths), taken, n_words)
        del taken
        out: list[list[np.ndarray]] = [[], [], [], []]

        def put(t: np.ndarray, sizes: np.ndarray) -> None:
            a, b = lined(t, sizes, h)
            owner, known = np.repeat(np.arange(len(sizes)), sizes), c[t] > 0
            gain = np.where(known, share[t], base[t])
            for at in range(0, len(t), CHUNK):
                k = at + np.flatnonzero(known[at : at + CHUNK])
                mixed = m.features(a[k], b[k])
                gain[k] += m.log_class(m.rows(mixed), prior, classes[t[k]])
                token, bit, bins, node = m.decisions(mixed, t[k], paths)
                z = m.log_odds(bins, node)
                np.negative(z, out=z, where=bit)
                np.exp(z, out=z)  # log odds stay below 80: counts of 31 bits bound them (_moves), so no power overflows
                z += 1
                gain[k] -= np.bincount(token, np.log(z, out=z), len(k))
            for col, v in zip(out, (sizes, np.bincount(owner, known, len(sizes)).astype(np.int64), np.bincount(owner, base[t], len(sizes)) / math.log(10), np.bincount(owner, gain, len(sizes)) / math.log(10)), strict=True):
                col.append(v)

        end = pc.index_in(pa.scalar(END), value_set=known_words).as_py()
        for batch in slices(docs.to_batches(), most=PIECE_BYTES):
            own, at, sizes = dealt(batch.column("text"))
            ids = np.full(sizes.sum(), end, np.int64)
            ids[at] = pc.index_in(own, value_set=known_words).to_numpy()
            for part in parts(ids, sizes, 1 << 15):
                put(*part)
        pa.default_memory_pool().release_unused()
        counted = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(counted[0], pa.int64()), "n_known": pa.array(counted[1], pa.int64()), "train_tokens": pa.array([total] * docs.num_rows, pa.int64()), "base_score": pa.array(counted[2], pa.float64()), "score": pa.array(counted[3], pa.float64())})

    return run


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text); scores are log10 probabilities."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    held_out = F.coalesce(crc_mod(FOLDS) == HELD_OUT, F.lit(False))
    keyed = docs.select("doc_id", "text", held_out.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    counts = saved(keyed.select("block", "text", (~F.col("held_out")).alias("train")).repartition("block").sortWithinPartitions("block").mapInArrow(_block_counts, "block long, word binary, n long"))
    vocab = saved(counts.groupBy("word").agg(F.sum("n").alias("c")))
    total, known = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_top, endings = Model.sizes(total)
    top = [bytes(r.word) for r in vocab.where("c > 0").orderBy(F.desc("c"), "word").limit(n_top).collect()]
    model = Model(top, endings, known, total)
    sc = docs.sparkSession.sparkContext
    placed = vocab.where("c > 0").mapInArrow(_placed(sc.broadcast(model), max(8, known // 200_000)), "part long, class long, h long, mass double")
    mass = placed.groupBy("part").applyInArrow(_node_mass(model.least), "node long, mass double, ones double").groupBy("node").agg(F.sum("mass").alias("mass"), F.sum("ones").alias("ones"))
    whole = F.col("node").bitwiseAND(F.lit((1 << 32) - 1)) == 1
    kept = mass.where(whole | ((F.col("mass") >= model.least) & (F.col("ones") > 0) & (F.col("ones") < F.col("mass")))).orderBy("node").toArrow()  # a row for each class and decision
    node, all_, ones = (kept[x].to_numpy() for x in ("node", "mass", "ones"))
    at = (node & ((1 << 32) - 1)) == 1
    model.mass[node[at] >> 32] = all_[at]
    split = (all_ >= model.least) & (ones > 0) & (ones < all_)
    model.decide(node[split].astype(np.int64), np.log(ones[split] / (all_[split] - ones[split])).astype(np.float32))
    if total:
        model = train(docs.where(~held_out).select("text"), model)
    back = counts.select("block", "word").join(vocab, "word").select("block", "word", "c")
    return keyed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(sc.broadcast(model), total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_lm_scores": op6_lm_scores}
ORACLES: dict[str, str] = {}
