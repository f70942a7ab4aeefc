"""Phrase collocation mining by Rabin-Karp fingerprints with occurrence pointers.

Texts are laid end to end in segments, which are written once. Prefix polynomials over a segment's words (in numpy,
modulo 2**64) give the fingerprint of every run of one to five words; a task counts equal fingerprints of a segment,
comparing every occurrence with the first one's words, and hands (fingerprint, count, segment, position of an
occurrence) to the shuffle. Fingerprints that reach the least count send their pointers back to the segments, and only there are
phrases taken from the text. Counts are then summed by the phrase itself, so two phrases that share a fingerprint part again.
Runs of three words enter the shuffle only where both their pairs are frequent, longer ones where all their triples are, since no
phrase is more frequent than its parts.

Null texts count as empty, a null lang as `und`, rows that repeat count each time, an empty table gives an empty table.
Columns besides text and lang are ignored, whatever their names. A text is held whole by one task, as Spark does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import forget, saved, slices, table, texts_of

# Contract of the query: least count, longest phrase, share (percent) at which a longer phrase replaces a shorter one, rows of a language.
LEAST, LONGEST, REPLACES, TOP = 100, 5, 100, 2000
#: Bytes of text in a segment; a longer text is a segment of its own.
SEGMENT = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_CLASS[[32, 9]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def polynomials(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end] for each pair: the sum of value times base to its place in the run, by prefix sums."""
    sums, inverse = prefixes(values)
    return (sums[end] - sums[start]) * inverse[start]


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of value times base to its place, inverse powers of base)."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, len(values))[:-1], out=sums[1:])
    return sums, _powers(_INVERSE, len(values))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


class Segment:
    """Words of a segment: ids (equal for equal words), places in the bytes, pieces, languages."""

    def __init__(self, text: bytes, doc_start: np.ndarray, doc_lang: np.ndarray, langs: list[str]):
        raw = np.frombuffer(text, np.uint8)
        kind = _CLASS[raw]
        of_word = kind == 0
        edge = np.diff(np.concatenate(([0], of_word.view(np.int8), [0])))
        self.text, self.langs = text, langs
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2)[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.lang = doc_lang[np.searchsorted(doc_start, self.start, "right") - 1] if len(self.start) else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(self.end - self.start))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[of_word]))]).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False)
        known = words.dictionary
        places = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1]
        letters = np.frombuffer(known.buffers()[2] or b"", np.uint8)[: places[-1] if len(known) else 0]
        self.sums, self.inverse = prefixes(_mixed(polynomials(_BYTE[letters], places[:-1], places[1:]))[self.ids] if len(known) else np.zeros(0, np.uint64))
        of_lang = np.array([polynomials(_BYTE[np.frombuffer(x.encode(), np.uint8)], np.array([0]), np.array([len(x.encode())]))[0] for x in langs], np.uint64)
        self.salt = _mixed(of_lang + np.uint64(1))[self.lang] if langs else np.zeros(0, np.uint64)

    def inside(self, n: int) -> np.ndarray:
        """Where runs of n words start that lie within one piece."""
        last = len(self.ids) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :][:last]) if last > 0 else np.zeros(0, np.int64)

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        return _mixed((self.sums[at + n] - self.sums[at]) * self.inverse[at] ^ self.salt[at]) if len(at) else np.zeros(0, np.uint64)

    def counted(self, at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(fingerprints, counts, positions) of the different runs that start at `at`; every occurrence's words are compared with the first's."""
        while len(at):
            prints = self.fingerprints(at, n)
            order = np.argsort(prints, kind="stable")
            prints, at = prints[order], at[order]
            first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
            sizes = np.diff(np.concatenate((first, [len(at)])))
            model = np.repeat(at[first], sizes)
            same = self.lang[at] == self.lang[model]
            for i in range(n):
                same &= self.ids[at + i] == self.ids[model + i]
            yield prints[first], np.add.reduceat(same.astype(np.int32), first), at[first]
            at = at[~same]  # other words under the same fingerprint: counted apart

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.text[self.start[i] : self.end[i]] for i in range(at, at + n)).decode()


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts end to end, lower-cased, a line end between them, in segments."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush():
        nonlocal number, held, size
        langs = sorted({x for _, x in held})
        code = {x: i for i, x in enumerate(langs)}
        lengths = [len(t) + 1 for t, _ in held]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        text = _LOWER[np.frombuffer(b"\n".join(t for t, _ in held), np.uint8)].tobytes()
        of = np.array([code[x] for _, x in held], np.int32)
        seg = Segment(text, starts, of, langs)
        words = np.bincount(seg.lang, minlength=len(langs)).tolist()
        row = [[(task << 24) + number], [len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)], [starts.tobytes()], [of.tobytes()], [langs], [words]]
        number, held, size = number + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary()), pa.array(row[3], pa.binary()), pa.array(row[4], pa.list_(pa.string())), pa.array(row[5], pa.list_(pa.int64()))], ["seg", "body", "starts", "doc_lang", "langs", "words"])

    for batch in slices(batches):
        for t, x in zip(texts_of(batch), batch.column("lang").to_pylist(), strict=True):
            if held and size + len(t) > SEGMENT:
                yield flush()
            held.append((t, "und" if x is None else x))
            size += len(t) + 1
    if held:
        yield flush()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Segment, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(number, segment, (positions, sizes, counts) of its pointers) of each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            number, body, starts, of, langs = (row.column(c)[0].as_py() for c in ("seg", "body", "starts", "doc_lang", "langs"))
            body = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
            what = row.column("at").flatten().to_numpy(zero_copy_only=False) if "at" in batch.schema.names else np.zeros(0, np.int64)
            yield number, Segment(body, np.frombuffer(starts, np.int64), np.frombuffer(of, np.int32), langs), (what >> (COUNT_BITS + 3), what >> COUNT_BITS & 7, what & (1 << COUNT_BITS) - 1)


#: what: position in the segment, 3 bits of the run's length, COUNT_BITS of its count there; a text has fewer than 2**30 words.
_PRINTS, COUNT_BITS = "fp long, seg long, what long", 30


def _rows(seg: int, n: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    prints, counts, at = found
    return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(np.full(len(at), seg, np.int64)), pa.array((at.astype(np.int64) * 8 + n) << COUNT_BITS | counts)], ["fp", "seg", "what"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of words and pairs."""
    for number, seg, _ in _opened(batches):
        for n in (1, 2):
            for found in seg.counted(seg.inside(n), n):
                yield _rows(number, n, found)


def _long(base: int, sizes: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of longer runs whose runs of `base` words are all frequent."""
        for number, seg, (places, lengths, _) in _opened(batches):
            frequent = np.zeros(len(seg.ids), bool)
            at = seg.inside(base)
            frequent[at] = np.isin(seg.fingerprints(at, base), seg.fingerprints(places[lengths == base], base))
            chain = frequent
            for n in range(base + 1, sizes.stop):
                chain = chain[:-1] & frequent[n - base :] if len(chain) > 1 else chain[:0]
                if n in sizes:
                    for found in seg.counted(np.flatnonzero(chain), n):
                        yield _rows(number, n, found)

    return run


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases that frequent fingerprints' pointers lead to, with their counts in the segment."""
    for _, seg, (places, sizes, counts) in _opened(batches):
        for i in range(0, len(places), 10_000):
            at, n = places[i : i + 10_000].tolist(), sizes[i : i + 10_000].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([seg.langs[seg.lang[p]] for p in at], pa.string()), pa.array([seg.phrase(p, k) for p, k in zip(at, n, strict=True)], pa.string()), pa.array(n, pa.int32()), pa.array(counts[i : i + 10_000].astype(np.int64))], ["lang", "phrase", "size", "cnt"])


def _pointers(prints: DataFrame, least: int) -> DataFrame:
    """(seg, at): pointers of the frequent fingerprints by segment; at most as many as the segment has different runs."""
    total = F.sum(F.col("what").bitwiseAND(F.lit((1 << COUNT_BITS) - 1))).over(Window.partitionBy("fp"))
    return prints.withColumn("total", total).where(F.col("total") >= least).groupBy("seg").agg(F.collect_list("what").alias("at"))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, a) of all phrases of at most `longest` words with a >= least, (lang, n)), both written tables."""
    body = docs.select("text", "lang")
    segments = saved(body.mapInArrow(_laid, "seg long, body binary, starts binary, doc_lang binary, langs array<string>, words array<long>"))
    sizes = saved(segments.select(F.explode(F.arrays_zip("langs", "words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.words").alias("n")))
    plain = segments.select("seg", "body", "starts", "doc_lang", "langs")
    found = [saved(_pointers(plain.mapInArrow(_short, _PRINTS), least))]
    for base, more in ((2, range(3, 4)), (3, range(4, longest + 1))):
        found.append(saved(_pointers(plain.join(found[-1], "seg").mapInArrow(_long(base, more), _PRINTS), least)))
    every = found[0].union(found[1]).union(found[2]).groupBy("seg").agg(F.flatten(F.collect_list("at")).alias("at"))
    parts = plain.join(every, "seg").mapInArrow(_phrases, "lang string, phrase string, size int, cnt long")
    counts = saved(parts.groupBy("lang", "phrase", "size").agg(F.sum("cnt").alias("a")).where(F.col("a") >= least))
    for t in (segments, *found):
        forget(t)
    return counts, sizes


def _run(k: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("w", F.lit(k) if isinstance(k, int) else k, F.lit(length) if isinstance(length, int) else length), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, replaces: int = REPLACES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    score is the least over the cuts of a phrase of floor(1000 a n / (l r)), l and r the counts of both parts. A phrase
    inside a longer candidate that has at least `replaces` percent of its count goes. Ties: first by count, then by bytes.
    """
    counts, sizes = phrase_counts(docs, least, longest)
    own = counts.select("lang", "phrase", "a")
    candidates = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _run(1, F.col("k")).alias("head"), _run(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(own.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(own.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]).join(sizes, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("bottom", wide("l") * wide("r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r")).alias("x"))
    inner = candidates.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    longer = inner.select("lang", _run(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(replaces) * F.col("a"), F.lit(True)))
    flat = kept.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLES: dict[str, str] = {}
