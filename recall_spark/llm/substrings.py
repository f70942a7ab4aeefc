"""Removal of repeated substrings by suffix arrays.

A byte goes if a string of `SPAN` bytes over it also starts in a document with a smaller doc_id. To find such
strings without bringing all suffixes together, every window of SPAN bytes is anchored at its least k-gram by
hash (the first of equals): equal windows have the same anchor at the same place. A context is a run of
windows of a document with one anchor. The steps are

1. senders: for each bucket of anchors, the hashes of anchors and contexts with the least doc_id that a task sees; a
   context that an earlier document of the task has is told to go at once;
2. receivers: a context that a smaller doc_id has goes; contexts whose anchor has others are ambiguous;
3. documents get back what concerns them, send the bytes of ambiguous contexts to the bucket of their anchor, and note
   the spans that go;
4. contexts of one anchor are laid end to end, and their suffix array brings equal windows together: windows that a
   smaller doc_id has go. Before that, windows go out that share no 33 bytes around the anchor with any other context;
5. the spans of a document are merged and cut out.

Nothing that one key holds is unbounded: an anchor with more than `MANY` contexts (or `LOCAL` in one task) is hot, and its
windows are dealt by their own hashes, where those that many documents share have been reduced to one per task.

Null text is empty. A null doc_id counts as larger than all others, and rows without one aren't smaller than each other; nor
are rows that repeat a doc_id. Identical rows give identical results. Columns of the input that have the name of a
result column are replaced; others are kept whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, saved, slices, spare, table, texts_of
from .suffixes import suffix_arrays

SPAN, GRAM = 50, 16
#: Windows that can share an anchor, and the length of the longest context.
REACH = SPAN - GRAM + 1
WIDTH = SPAN + REACH - 1
#: Different contexts from which on an anchor is hot, over all and within one task; symbols of a string that is sorted.
MANY, LOCAL, SYMBOLS = 4096, 512, 2048
#: Symbols that are sorted at once, in rows side by side.
ROW_SYMBOLS = 2_000_000
#: Text that a sender sums up at a time, and that a bucket has, in bytes, about.
HELD, BUCKET = 32_000_000, 12_000_000
_LAST = (1 << 63) - 1
_POS = np.uint64((1 << 24) - 1)
_MIX, _MUL, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
#: What a document is told about a context.
GOES, AMBIGUOUS, HOT = 1, 2, 3


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the k-gram at every place."""
    h = (raw.astype(np.uint64) + _u(1)) * _MIX
    step = 1
    while step < GRAM:
        h = h[:-step] * _u(pow(int(_MUL), step, 1 << 64)) + h[step:]
        step *= 2
    h ^= h >> _u(32)
    h *= _MUL
    return h


def _runs(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs in which all values stay equal."""
    n = len(values[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.zeros(n - 1, bool)
    for v in values:
        change |= v[1:] != v[:-1]
    edges = np.flatnonzero(change) + 1
    return np.r_[0, edges], np.r_[edges, n]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Contexts:
    """Runs of windows with one anchor over texts laid end to end: own text, first window, behind its last, place and hash of the anchor."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        raw = self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.own = self.a = self.b = self.p = np.empty(0, np.int64)
        self.g = np.empty(0, np.uint64)
        if len(raw) < SPAN:
            return
        h = self.h = np.empty(len(raw) - GRAM + 1, np.uint64)
        places, cut = [], 1 << 15  # pieces that a processor's cache holds
        for start in range(0, len(raw) - SPAN + 1, cut):
            part = gram_hashes(raw[start : start + cut + SPAN - 1])
            h[start : start + len(part)] = part
            low = (part & ~_POS) | np.arange(len(part), dtype=np.uint64)
            step = 1
            while step * 2 <= REACH:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            if step < REACH:
                low = np.minimum(low[: step - REACH], low[REACH - step :])
            places.append((low & _POS).astype(np.int64) + start)
        place = np.concatenate(places)[: len(raw) - SPAN + 1]
        over = np.zeros(len(place) + 1, np.int32)  # windows over the end of a text don't count
        np.add.at(over, np.clip(ends - SPAN + 1, self.starts, len(place)), 1)
        np.add.at(over, np.minimum(ends, len(place)), -1)
        place[np.cumsum(over[:-1]) > 0] = -1
        a, b = _runs(place)
        ok = place[a] >= 0
        self.a, self.b = a[ok], b[ok]
        self.p = place[self.a]
        self.own = np.searchsorted(ends, self.a, side="right")
        g = h[self.p] * _ODD
        self.g = g ^ (g >> _u(33))

    def _hash(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the bytes from first to the end of the k-gram at last, which k-grams cover."""
        out = self.h[first]
        for k in range(1, -(-WIDTH // GRAM)):
            out = (out ^ (out >> _u(29))) * _ODD + self.h[np.minimum(first + GRAM * k, last)]
        return (out ^ (out >> _u(32))) * _MUL

    def ids(self) -> np.ndarray:
        """Hash of each context's bytes."""
        return self._hash(self.a, self.b + SPAN - 1 - GRAM)

    def windows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, place, hash) of every window of contexts k."""
        n = self.b[k] - self.a[k]
        at = _ranges(self.a[k], n)
        return np.repeat(k, n), at, self._hash(at, at + SPAN - GRAM)


def _six(h: np.ndarray) -> bytes:
    """The upper six bytes of each hash; with the bucket they tell anchors apart, and what they confuse is compared byte by byte later."""
    return np.ascontiguousarray((h >> _u(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    h = np.zeros((len(raw) // 6, 8), np.uint8)
    h[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return h.view(np.uint64).ravel()


def _key(anchor: np.ndarray, bucket: np.ndarray | int, context: np.ndarray) -> np.ndarray:
    """One number for a context, from the six bytes of its anchor's and its own hash, and the bucket."""
    x = ((anchor << _u(16)) ^ (np.asarray(bucket).astype(np.uint64) * _MIX)) * _ODD + context * _MUL
    return (x ^ (x >> _u(31))) * _MIX


def _table(columns: dict[str, tuple[list, pa.DataType]], kind=pa.RecordBatch):
    return kind.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _ints(*values: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(v).tobytes() for v in values]


_SENT = "bucket long, hot boolean, docs binary, tos binary, counts binary, anchors binary, contexts binary"
_TOLD = "to long, docs binary, keys binary, kinds binary"


def _sender(buckets: int, local: int):
    """Step 1. Rows of a bucket name anchors and contexts, in runs of one document; rows of bucket -1 - to tell documents at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tos, owners, anchors, ids, held, n = [], [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            doc_of, to_of, own = np.array(docs, np.int64), np.array(tos, np.int64), np.concatenate(owners)
            g, c = np.concatenate(anchors), np.concatenate(ids)
            bucket, g, c, d, t = (g % _u(buckets)).astype(np.int64), g >> _u(16), c >> _u(16), doc_of[own], to_of[own]
            by = np.lexsort((t, d, c, g, bucket))
            bucket, g, c, d, t = (x[by] for x in (bucket, g, c, d, t))
            a, _ = _runs(bucket, g, c, d, t)
            bucket, g, c, d, t = (x[a] for x in (bucket, g, c, d, t))
            a, b = _runs(bucket, g, c)
            later = d > np.repeat(d[a], b - a)
            a, b = _runs(bucket, g)
            kinds = np.add.reduceat(_firsts(bucket, g, c), a) if len(a) else a
            hot = np.repeat(kinds > local, b - a)
            told = later | hot
            out: dict[str, tuple[list, pa.DataType]] = {k: ([], x) for k, x in zip(("bucket", "hot", "docs", "tos", "counts", "anchors", "contexts"), (pa.int64(), pa.bool_(), *[pa.binary()] * 5), strict=True)}

            def put(*row) -> None:
                for col, x in zip(out.values(), row, strict=True):
                    col[0].append(x)

            if told.any():
                k = np.flatnonzero(told)
                k = k[np.lexsort((d[k], t[k]))]
                keys, what = _key(g[k], bucket[k], c[k]), np.where(later[k], GOES, HOT).astype(np.uint8)
                for x, y in zip(*_runs(t[k]), strict=True):
                    u, v = _runs(d[k[x:y]])
                    put(-1 - int(t[k[x]]), None, *_ints(d[k[x:y]][u]), None, *_ints((v - u).astype(np.uint32), keys[x:y], what[x:y]))
            a, b = _runs(bucket, g)
            a = a[kinds > local]
            for x, y in zip(*_runs(bucket[a]), strict=True):
                put(int(bucket[a[x]]), True, None, None, None, _six(g[a[x:y]] << _u(16)), None)
            k = np.flatnonzero(~told)
            k = k[np.lexsort((t[k], d[k], bucket[k]))]
            for x, y in zip(*_runs(bucket[k]), strict=True):
                part = k[x:y]
                u, v = _runs(d[part], t[part])
                put(int(bucket[part[0]]), False, *_ints(d[part][u], t[part][u].astype(np.uint32), (v - u).astype(np.uint32)), _six(g[part] << _u(16)), _six(c[part] << _u(16)))
            return _table(out)

        for batch in slices(batches):
            texts = texts_of(batch)
            found = Contexts(texts)
            owners.append(found.own + n)
            anchors.append(found.g)
            ids.append(found.ids() if len(found.g) else found.g)
            docs += batch.column("doc_id").to_pylist()
            tos += batch.column("to").to_pylist()
            n += len(texts)
            held += sum(map(len, texts))
            if held >= HELD:
                yield flush()
                docs, tos, owners, anchors, ids, held, n = [], [], [], [], [], 0, 0
        if docs:
            yield flush()

    return run


def _firsts(*values: np.ndarray) -> np.ndarray:
    """1 where a run of equal values starts, else 0."""
    out = np.zeros(len(values[0]), np.int64)
    out[_runs(*values)[0]] = 1
    return out


def _receiver(many: int, got: pa.Table) -> pa.Table:
    """Step 2: for the documents of each `to`, what becomes of their contexts with anchors of this bucket."""
    bucket = got["bucket"][0].as_py()
    out: dict[str, tuple[list, pa.DataType]] = {"to": ([], pa.int64()), "docs": ([], pa.binary()), "keys": ([], pa.binary()), "kinds": ([], pa.binary())}
    if bucket < 0:
        for d, n, keys, kinds in zip(*(got[c].to_pylist() for c in ("docs", "counts", "anchors", "contexts")), strict=True):
            for col, x in zip(out.values(), (-1 - bucket, np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.uint32)).tobytes(), keys, kinds), strict=True):
                col[0].append(x)
        return _table(out, pa.Table)
    rows = got.select(["hot", "docs", "tos", "counts", "anchors", "contexts"]).to_pylist()
    hot = np.unique(np.concatenate([np.empty(0, np.uint64), *(_of_six(r["anchors"]) for r in rows if r["hot"])]))
    rows = [r for r in rows if not r["hot"]]
    if not rows:
        return _table(out, pa.Table)
    sizes = [np.frombuffer(r["counts"], np.uint32) for r in rows]
    d = np.concatenate([np.repeat(np.frombuffer(r["docs"], np.int64), n) for r, n in zip(rows, sizes, strict=True)])
    t = np.concatenate([np.repeat(np.frombuffer(r["tos"], np.uint32), n) for r, n in zip(rows, sizes, strict=True)])
    g, c = (np.concatenate([_of_six(r[k]) for r in rows]) for k in ("anchors", "contexts"))
    by = np.lexsort((d, c, g))
    d, t, g, c = d[by], t[by], g[by], c[by]
    a, b = _runs(g, c)
    kind = np.where(d > np.repeat(d[a], b - a), GOES, 0).astype(np.uint8)
    a, b = _runs(g)
    kinds = np.add.reduceat(_firsts(g, c), a)
    large = (kinds > many) | np.isin(g[a], hot)
    other = np.where(large, HOT, np.where(kinds > 1, AMBIGUOUS, 0))
    kind = np.where(kind == GOES, kind, np.repeat(other, b - a)).astype(np.uint8)
    k = np.flatnonzero(kind)
    k = k[np.argsort(t[k], kind="stable")]
    keys = _key(g[k], bucket, c[k])
    for x, y in zip(*_runs(t[k]), strict=True):
        for col, v in zip(out.values(), (int(t[k[x]]), *_ints(d[k[x:y]], keys[x:y], kind[k[x:y]])), strict=True):
            col[0].append(v)
    return _table(out, pa.Table)


#: bucket -1 has spans that go; others have contexts, or windows of hot anchors, of an anchor's bucket.
_PARTS = "bucket long, to long, windows boolean, docs binary, marks binary, starts binary, ends binary, anchors binary, bytes binary"
_NO_SPANS = {"docs": np.int64, "marks": np.int64, "starts": np.int32, "ends": np.int32}


def _parts(columns: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in _PARTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 6)
    return pa.table({n: pa.array([r[i] for r in columns], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _documents(buckets: int):
    """Step 3, over the documents of one `to` and what they are told."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not told.num_rows or not docs.num_rows:
            return _parts(out)
        to = told["to"][0].as_py()
        key, about, kind = (np.concatenate([np.frombuffer(x, k) for x in told[c].to_pylist()]) for c, k in (("keys", np.uint64), ("docs", np.uint64), ("kinds", np.uint8)))
        key = key ^ (about * _ODD)
        by = np.argsort(key)
        key, kind = key[by], kind[by]
        for batch in slices(docs.to_batches()):
            found = Contexts(texts_of(batch))
            if not len(found.g):
                continue
            doc, mark = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
            ids, bucket = found.ids(), (found.g % _u(buckets)).astype(np.int64)
            own = _key(found.g >> _u(16), bucket, ids >> _u(16)) ^ (doc.view(np.uint64) * _ODD)[found.own]
            i = np.minimum(np.searchsorted(key, own), len(key) - 1)
            what = np.where(key[i] == own, kind[i], 0)
            base = found.starts[found.own]
            k = np.flatnonzero(what == GOES)
            if len(k):  # neighbours that both go make one span
                joined = np.r_[False, (found.own[k[1:]] == found.own[k[:-1]]) & (found.a[k[1:]] == found.b[k[:-1]])]
                head = np.flatnonzero(~joined)
                last = np.r_[head[1:], len(k)] - 1
                o = found.own[k[head]]
                out.append((-1, to, None, *_ints(doc[o], mark[o], (found.a[k[head]] - base[k[head]]).astype(np.int32), (found.b[k[last]] + SPAN - 1 - base[k[head]]).astype(np.int32)), None, None))
            k = np.flatnonzero(what == AMBIGUOUS)
            k = k[np.argsort(bucket[k], kind="stable")]
            for x, y in zip(*_runs(bucket[k]), strict=True):
                j = k[x:y]
                o, n = found.own[j], found.b[j] - found.a[j] + SPAN - 1
                shape = np.stack([found.p[j] - found.a[j], n]).astype(np.uint8)
                out.append((int(bucket[j[0]]), to, False, *_ints(doc[o], mark[o], (found.a[j] - base[j]).astype(np.int32), shape, found.g[j], found.raw[_ranges(found.a[j], n)])))
            k = np.flatnonzero(what == HOT)
            if len(k):
                j, place, h = found.windows(k)
                o, start = found.own[j], (place - base[j]).astype(np.int32)
                by = np.lexsort((doc[o], h))
                j, o, start, h = j[by], o[by], start[by], h[by]
                a, b = _runs(h, found.g[j])
                later = doc[o] > np.repeat(doc[o][a], b - a)
                if later.any():
                    out.append((-1, to, None, *_ints(doc[o[later]], mark[o[later]], start[later], start[later] + np.int32(SPAN)), None, None))
                j, o, start, h = j[~later], o[~later], start[~later], h[~later]
                dealt = ((h ^ (h >> _u(32))) % _u(buckets)).astype(np.int64)
                by = np.argsort(dealt, kind="stable")
                for x, y in zip(*_runs(dealt[by]), strict=True):
                    z = by[x:y]
                    out.append((int(dealt[z[0]]), to, True, *_ints(doc[o[z]], mark[o[z]], start[z]), None, *_ints(found.g[j[z]], h[z])))
        return _parts(out)

    return run


_BYTE = np.frombuffer(hashlib.shake_128(b"bytes").digest(2048), np.uint64)
_POWERS = np.array([pow(int(_MUL), i, 1 << 64) for i in range(WIDTH)], np.uint64)


class Strings:
    """Contexts as rows of bytes, aligned at their anchors; window d of a context starts d bytes before the anchor."""

    def __init__(self, shape: np.ndarray, raw: np.ndarray):
        self.at, n = (x.astype(np.int64) for x in shape)
        self.low, self.high = self.at - (n - SPAN), self.at.copy()
        self.rows = np.zeros((len(n), WIDTH), np.uint8)
        self.rows[np.repeat(np.arange(len(n)), n), _ranges(REACH - 1 - self.at, n)] = raw

    def hash(self, k: np.ndarray, low: int, high: int, seed: np.ndarray) -> np.ndarray:
        """Of what windows low to high of contexts k have in common."""
        x = (_BYTE[self.rows[k, REACH - 1 - low : WIDTH - high]] * _POWERS[: SPAN + low - high]).sum(axis=1, dtype=np.uint64) + seed * _MIX
        return (x ^ (x >> _u(31))) * _ODD


def _shared(key: np.ndarray) -> np.ndarray:
    """Where a key occurs more than once."""
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def _strings(s: Strings, anchor: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces that can share windows, as (whether pieces are one window, context, least window, greatest window, group).

    A group is an anchor's contexts, without windows that share no 33 bytes around the anchor with another context. If a group
    has more than SYMBOLS bytes, its windows are split in two by their place around the anchor, and grouped by what each half has
    in common; equal windows stay together.
    """
    half = (REACH - 1) // 2
    k = np.arange(len(anchor))
    right, left = k[s.low <= half], k[s.high >= half]
    on_right, on_left = np.zeros(len(k), bool), np.zeros(len(k), bool)
    on_right[right] = _shared(s.hash(right, 0, half, anchor[right]))
    on_left[left] = _shared(s.hash(left, half, REACH - 1, anchor[left]))
    low, high = np.where(on_right, s.low, np.maximum(s.low, half)), np.where(on_left, s.high, np.minimum(s.high, half))
    k = np.flatnonzero(on_right | on_left)
    todo, small = [(k, low[k], high[k], anchor[k], 0, REACH - 1)], []
    while todo:
        k, low, high, key, first, last = todo.pop()
        by = np.argsort(key, kind="stable")
        k, low, high, key = k[by], low[by], high[by], key[by]
        a, b = _runs(key)
        if not len(a):
            continue
        if first == last:
            yield True, k, low, high, key
            continue
        size = np.add.reduceat(high - low + SPAN + 1, a)
        large = np.repeat(size > SYMBOLS, b - a)
        several = np.repeat(b - a > 1, b - a) & ~large
        small.append((k[several], low[several], high[several], key[several]))
        if large.any():
            k, low, high, key = k[large], low[large], high[large], key[large]
            middle = (first + last) // 2
            for x, y in ((first, middle), (middle + 1, last)):
                on = np.flatnonzero((low <= y) & (high >= x))
                new = s.hash(k[on], x, y, key[on])
                many = _shared(new)
                on, new = on[many], new[many]
                todo.append((k[on], np.maximum(low[on], x), np.minimum(high[on], y), new, x, y))
    if small:
        yield False, *(np.concatenate(x) for x in zip(*small, strict=True))


def _equal(s: Strings, doc: np.ndarray, k: np.ndarray, d: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of pieces of one window each that a smaller document has."""
    a, b = _runs(key)
    each = b - a
    rows = s.rows[k[:, None], REACH - 1 - d[:, None] + np.arange(SPAN)]
    same = (rows == np.repeat(rows[a], each, axis=0)).all(axis=1)
    least = np.repeat(np.minimum.reduceat(np.where(same, doc[k], _LAST), a), each)
    goes = same & (doc[k] > least)
    return k[goes], d[goes]


def _later(s: Strings, doc: np.ndarray, k: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, window) of all windows of pieces that a smaller document has, by suffix arrays of groups laid end to end in rows."""
    a, b = _runs(key)
    if not len(a):
        return
    n = high - low + SPAN
    size = np.add.reduceat(n + 1, a)
    width = max(int(size.max()), min(SYMBOLS, int(size.sum()) // 2000))
    offset, used, rows = np.empty(len(a), np.int64), width, -1
    for i, x in enumerate(size.tolist()):
        if used + x > width:
            used, rows = 0, rows + 1
        offset[i] = rows * width + used
        used += x
    step = max(1, ROW_SYMBOLS // width) * width
    cuts = np.searchsorted(offset, np.arange(0, (rows + 1) * width + step, step))
    for x, y in zip(cuts, cuts[1:], strict=False):
        if x == y:
            continue
        base = offset[x] // width * width
        j = np.arange(a[x], b[y - 1])  # pieces
        before = np.cumsum(n[j] + 1) - (n[j] + 1)
        at = before + np.repeat(offset[x:y] - base - before[a[x:y] - a[x]], b[x:y] - a[x:y])
        total = (int(offset[y - 1]) - int(base)) // width + 1
        sym = np.zeros(total * width, np.int16)
        cells = _ranges(at, n[j])
        sym[cells] = s.rows[np.repeat(k[j], n[j]), _ranges(REACH - 1 - high[j], n[j])]
        sym[cells] += 1
        starts = high[j] - low[j] + 1  # windows of a piece
        cells = _ranges(at, starts)
        piece = np.full(len(sym), -1, np.int32)
        piece[cells] = np.repeat(j, starts)
        shift = np.zeros(len(sym), np.int16)
        shift[cells] = _ranges(np.zeros(len(j), np.int64), starts)
        found = (suffix_arrays(sym.reshape(total, width)) + np.arange(total, dtype=np.int64)[:, None] * width).ravel()
        found = found[piece[found] >= 0]
        eight = np.zeros(len(sym) + 8, np.uint64)
        for i in range(8):
            eight[: len(sym) - i] |= (sym[i:] - 1).astype(np.uint8).astype(np.uint64) << _u(8 * i)
        same = np.zeros(len(found), bool)
        same[1:] = found[1:] // width == found[:-1] // width
        for i in (*range(0, SPAN - 8, 8), SPAN - 8):
            on = np.flatnonzero(same)
            same[on] = eight[found[on] + i] == eight[found[on - 1] + i]
        begin = np.flatnonzero(~same)
        holder = doc[k[piece[found]]]
        least = np.repeat(np.minimum.reduceat(holder, begin), np.diff(np.r_[begin, len(holder)]))
        goes = found[holder > least]
        yield k[piece[goes]], high[piece[goes]] - shift[goes]


def _windows(got: pa.Table) -> pa.Table:
    """Step 4, over what one bucket of anchors has: the spans that go, for each `to`."""
    spans: list[tuple[np.ndarray, ...]] = []
    read = lambda rows, c, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[c].to_pylist()])

    def columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
        to = np.repeat(rows["to"].to_numpy(), [len(x) // 8 for x in rows["docs"].to_pylist()])
        return to, read(rows, "docs", np.int64), read(rows, "marks", np.int64), read(rows, "starts", np.int32), read(rows, "anchors", np.uint64)

    flag = got["windows"].to_numpy(zero_copy_only=False).astype(bool)
    if flag.any():
        rows = got.filter(pa.array(flag))
        to, doc, mark, start, g = columns(rows)
        h = read(rows, "bytes", np.uint64)
        by = np.lexsort((doc, g, h))
        to, doc, mark, start, g, h = (x[by] for x in (to, doc, mark, start, g, h))
        a, b = _runs(h, g)
        later = doc > np.repeat(doc[a], b - a)
        spans.append((to[later], doc[later], mark[later], start[later], start[later] + np.int32(SPAN)))
    if not flag.all():
        rows = got.filter(pa.array(~flag))
        to, doc, mark, start, g = columns(rows)
        shape = np.concatenate([np.frombuffer(x, np.uint8).reshape(2, -1) for x in rows["ends"].to_pylist()], axis=1)
        s = Strings(shape, read(rows, "bytes", np.uint8))
        for single, *pieces in _strings(s, g):
            for k, d in [_equal(s, doc, *pieces[:2], pieces[3])] if single else _later(s, doc, *pieces):
                first = start[k] + s.at[k] - d  # of the window in its document
                by = np.lexsort((first, mark[k], doc[k], to[k]))
                k, first = k[by], first[by]
                x = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (first[1:] != first[:-1] + 1)][: len(k)])
                y = np.r_[x[1:], len(k)] - 1
                spans.append((to[k[x]], doc[k[x]], mark[k[x]], first[x].astype(np.int32), (first[y[: len(x)]] + SPAN).astype(np.int32)))
    out: list[tuple] = []
    if spans:
        to, *rest = (np.concatenate(x) for x in zip(*spans, strict=True))
        by = np.argsort(to, kind="stable")
        for x, y in zip(*_runs(to[by]), strict=True):
            out.append((-1, int(to[by[x]]), None, *_ints(*(v[by[x:y]] for v in rest)), None, None))
    return _parts(out)


def _merged(got: pa.Table) -> pa.Table:
    """Step 5: (doc_id, mark, spans) of each document, spans as starts and ends of maximal runs."""
    doc, mark, a, b = (np.concatenate([np.frombuffer(x, k) for x in got[c].to_pylist()]) for c, k in _NO_SPANS.items())
    by = np.lexsort((a, mark, doc))
    doc, mark, a, b = (x[by] for x in (doc, mark, a.astype(np.int64), b.astype(np.int64)))
    starts, ends = _runs(doc, mark)
    own = np.repeat(np.arange(len(starts)), ends - starts)
    wide = np.int64(1) << np.int64(32)
    reach = np.maximum.accumulate(b + own * wide) - own * wide  # how far the spans so far go
    head = np.r_[True, (own[1:] != own[:-1]) | (a[1:] > reach[:-1])][: len(a)]
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(a)][: len(first)] - 1
    laid = np.stack([a[first], reach[last]])
    edges = np.searchsorted(own[first], np.arange(len(starts) + 1)).tolist()
    return pa.table({"doc_id": pa.array(doc[starts]), "mark": pa.array(mark[starts]), "spans": pa.array([laid[:, x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)], pa.binary())})


def cut_spans(text: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """(the remaining bytes, number of maximal removed runs)."""
    if not spans:
        return text, 0
    a, b = np.frombuffer(spans, np.int64).reshape(2, -1)
    kept = [text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)]
    return b"".join(kept), len(a)


RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def _finish(columns: int, text: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = texts_of(batch, text)
            rest = [cut_spans(t, x) for t, x in zip(texts, batch.column(spans).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(x) for t, (x, _) in zip(texts, rest, strict=True)], pa.int64()), pa.array([k for _, k in rest], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in rest], pa.string()), pa.array([x.decode("utf-8", "ignore") for x, _ in rest], pa.string())],
                names=[*batch.schema.names[:columns], *RESULTS],
            )

    return run


def removed_spans(docs: DataFrame, many: int = MANY, local: int = LOCAL) -> DataFrame:
    """(doc_id, mark, spans): removed byte spans of documents (doc_id, mark, text) that lose any; mark tells texts of a doc_id apart."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(64, size // BUCKET)
    which = F.when(F.col("doc_id") == _LAST, F.col("mark")).otherwise(F.xxhash64("doc_id"))
    dealt = docs.where(F.octet_length("text") >= SPAN).select("doc_id", "mark", "text", F.pmod(which, F.lit(buckets)).alias("to"))
    told = saved(dealt.select("doc_id", "to", "text").mapInArrow(_sender(buckets, local), _SENT).groupBy("bucket").applyInArrow(lambda got: _receiver(many, got), _TOLD))
    parts = saved(dealt.groupBy("to").cogroup(told.groupBy("to")).applyInArrow(_documents(buckets), _PARTS))
    forget(told)
    found = saved(parts.where("bucket >= 0").groupBy("bucket").applyInArrow(_windows, _PARTS))
    spans = parts.where("bucket < 0").union(found).select("to", *_NO_SPANS)
    out = saved(spans.groupBy("to").applyInArrow(_merged, "doc_id long, mark long, spans binary"))
    forget(parts)
    forget(found)
    return out


def without_repeats(docs: DataFrame, many: int = MANY, local: int = LOCAL) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and kept_text for each row; needs doc_id and text.

    kept_text leaves out what remains of characters that were cut.
    """
    doc, mark, text, spans = (spare(docs, x) for x in ("doc", "mark", "body", "spans"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    keyed = docs.select(key.alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    found = removed_spans(keyed, many, local).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(spans))
    names = [c for c in docs.columns if c not in RESULTS]
    lined = docs.select(*(F.col(f"`{c}`") for c in names), key.alias(doc), F.xxhash64("text").alias(mark), F.col("text").alias(text))
    both = lined.join(found, [doc, mark], "left").select(*(F.col(f"`{c}`") for c in names), text, spans)
    zero = F.lit(0).cast("long")
    schema = docs.select(*(F.col(f"`{c}`") for c in names), *(zero.alias(c) for c in RESULTS[:3]), F.lit("").alias("kept_sha256"), F.lit("").alias("kept_text")).schema
    return both.mapInArrow(_finish(len(names), text, spans), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULTS[:4])


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
