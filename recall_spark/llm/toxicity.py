"""Toxicity by class-conditional Kneser-Ney word models.

For the toxic and the ordinary class a bigram model is counted over labelled documents. It backs off to continuation counts of
words, then of word stems, then to one distribution that both classes share. What discounting frees is the same share in both classes, the
larger of the two, so an expression that neither class has seen often costs both the same. A toxic text is mostly made of
ordinary wording: the toxic likelihood of a word is a mixture of the two models, with a small part (`PARTS`) for the toxic
one. A text's evidence is the difference of its two log-likelihoods, divided by its length; a logistic curve, fitted on
labelled documents that the counts leave out, makes it a score, and the part is the one with which that curve fits best.

Counting uses at most `DOCS` labelled documents of each class (those with the least hash of doc_id); scoring
covers every word of every document. doc_id, lang and source are never part of a score.

Null and empty texts have no evidence and get the curve's value at zero. With no labels of a class, scores
are the share of toxic labels. A document with several labels counts as toxic if any says so; labels without a doc_id don't count.
Rows that repeat a doc_id are scored each; a null doc_id is not held out. An input column `toxicity` is replaced. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, forget, saved, slices, table, texts_of

DOCS, FOLDS, STEM, PRIOR_WORDS = 2500, 5, 4, 15
#: Counts up to the discount are given to the backoff in full. All counts are of distinct words before,
#: so that copies of a text count once.
DISCOUNT, PAIR_DISCOUNT = 2.5, 3
TOXIC_WEIGHT = 0.3
#: Shares of a toxic text's words that may be toxic wording; calibration chooses.
PARTS = (0.3, 0.1, 0.03, 0.01, 0.003)
#: ASCII letters in lower case and digits stay, other ASCII parts words; bytes of other characters stay.
_PARTS = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PARTS).split()


def stem_of(word: bytes) -> bytes:
    """The first STEM characters; a word no longer than that is a stem of its own."""
    return word.decode("utf-8", "replace")[:STEM].encode() + b"-" * (len(word) > STEM)


def labelled(labels: DataFrame, docs_per_class: int = DOCS) -> DataFrame:
    """(doc_id, toxic) of at most docs_per_class labelled rows a class, chosen by hash; the held-out fold never is."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(crc_mod(FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_per_class)
    return pick(0).union(pick(1))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        seen: set = set()
        for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
            words = words_of(text)
            seen.update(zip(repeat(toxic), [b"", b"", *words[:-2]], [b"", *words[:-1]], words, strict=False))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), *(pa.array([k[i] for k in keys], pa.binary()) for i in (1, 2, 3))], names=["toxic", "u", "v", "w"])


class Model:
    """Likelihood ratios of toxic to ordinary for every known bigram, word and stem.

    bigram -> word (continuation counts) -> stem (a word's first letters) -> the distribution both classes share
    """

    def __init__(self, words: pa.Table, heads: pa.Table, pairs: pa.Table):
        """Counts by class (toxic): words (w, n: distinct words before), heads (v, n: tokens behind), pairs (v, w, n) beyond PAIR_DISCOUNT."""
        lists = {k: (t["toxic"].to_numpy(), t["n"].to_numpy().astype(float), *(t[c].to_pylist() for c in t.column_names if c in "vw")) for k, t in (("words", words), ("heads", heads), ("pairs", pairs))}
        self.words = {x: i for i, x in enumerate(dict.fromkeys([b"", *lists["heads"][2], *lists["words"][2]]))}
        self.stems: dict[bytes, int] = {}
        stem = np.array([self.stems.setdefault(stem_of(x), len(self.stems)) for x in self.words] + [len(self.stems)])
        size, stems = len(self.words) + 1, len(self.stems) + 1  # the last ids: an unknown word, an unknown stem
        ids = lambda xs: np.fromiter(map(self.words.get, xs), np.int64, len(xs))
        toxic, n, w = lists["words"]
        wi = ids(w)
        cont = [np.bincount(wi[toxic == c], n[toxic == c], minlength=size) for c in (0, 1)]
        shared = np.bincount(stem, cont[0] + cont[1], minlength=stems) + 0.5
        shared = shared / shared.sum()
        inside = cont[0] + cont[1] + 0.5  # of a word within its stem, for both classes
        inside = inside / np.bincount(stem, inside, minlength=stems)[stem]
        by_stem = self._backed_off([np.bincount(stem, x, minlength=stems) for x in cont], shared)
        by_word = self._backed_off(cont, [x[stem] * inside for x in by_stem])
        toxic, n, v = lists["heads"]
        vi = ids(v)
        tokens = [np.maximum(np.bincount(vi[toxic == c], n[toxic == c], minlength=size), 1) for c in (0, 1)]
        toxic, n, v, w = lists["pairs"]
        vi, wi = ids(v), ids(w)
        pair = vi * size + wi
        self.keys = np.unique(pair)
        kv, kw = self.keys // size, self.keys % size
        kept, mass = [np.zeros(len(self.keys)) for _ in (0, 1)], []
        for c in (0, 1):
            own = toxic == c
            kept[c][np.searchsorted(self.keys, pair[own])] = n[own] - PAIR_DISCOUNT
            mass.append(np.bincount(kv, kept[c], minlength=size))
        freed = np.maximum(*(1 - m / t for m, t in zip(mass, tokens, strict=True)))
        of_pair = [(1 - freed[kv]) * k / np.maximum(m[kv], 1e-9) + freed[kv] * p[kw] for k, m, p in zip(kept, mass, by_word, strict=True)]
        self.size = size
        self.by_pair, self.by_word, self.by_stem = ((x[1] / x[0]).astype(np.float32) for x in (of_pair, by_word, by_stem))
        self.part, self.slope, self.shift = PARTS[0], 1.0, 0.0

    @staticmethod
    def _backed_off(counts: list[np.ndarray], below) -> list[np.ndarray]:
        """Discounted counts of both classes with the same share freed for the level below (one for both, or one each)."""
        below = below if isinstance(below, list) else [below, below]
        kept = [np.maximum(c - DISCOUNT, 0) for c in counts]
        freed = max(1 - k.sum() / max(c.sum(), 1) for k, c in zip(kept, counts, strict=True))
        return [(1 - freed) * k / max(k.sum(), 1e-9) + freed * b for k, b in zip(kept, below, strict=True)]

    def ratios(self, text: bytes) -> np.ndarray:
        """Toxic to ordinary likelihood of each word."""
        words = words_of(text)
        w = np.fromiter(map(self.words.get, words, repeat(self.size - 1)), np.int64, len(words))
        pair = np.r_[0, w[:-1]] * self.size + w
        rest = self.by_word[w]
        for i in np.flatnonzero(w == self.size - 1):
            rest[i] = self.by_stem[self.stems.get(stem_of(words[i]), -1)]
        if not len(self.keys):
            return rest
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.by_pair[at], rest)

    def evidence(self, text: bytes, parts: tuple[float, ...] | None = None) -> list[float]:
        """Toxic minus ordinary log-likelihood per word, for each part; PRIOR_WORDS without evidence steady short texts."""
        r = self.ratios(text) - 1
        return [float(np.log1p(part * r).sum(dtype=np.float64) / (len(r) + PRIOR_WORDS)) for part in parts or (self.part,)]

    def score(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> None:
        """Logistic fit by Newton steps, for the part (a row of x each) that fits best. The toxic class weighs TOXIC_WEIGHT of the whole, however many labels it has."""
        weight = np.where(y == 1, TOXIC_WEIGHT / max((y == 1).sum(), 1), (1 - TOXIC_WEIGHT) / max((y == 0).sum(), 1))
        best = np.inf
        for part, own in zip(PARTS, x, strict=True):
            scale = max(float(own.std()), 1e-9)
            a = np.c_[own / scale, np.ones(len(own))]
            b = np.zeros(2)
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
                g = a.T @ (weight * (y - p)) - ridge * b * [1, 0]
                b = b + np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + np.diag([ridge, 1e-9]), g)
            loss = float((weight * np.logaddexp(0, -(2 * y - 1) * (a @ b))).sum())
            if loss < best:
                best, self.part, self.slope, self.shift = loss, part, b[0] / scale, b[1]


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS) -> Model | float:
    """The model, or the share of toxic labels if a class has none. Counts come to the driver by word, and by pair only beyond the discount."""
    chosen = F.broadcast(labelled(labels, docs_per_class))  # at most 2 * docs_per_class rows
    own = docs.select("doc_id", "text").join(chosen, "doc_id")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0
    pairs = saved(own.where(~apart).select("toxic", "text").mapInArrow(_pair_counts, "toxic int, u binary, v binary, w binary").distinct().groupBy("toxic", "v", "w").agg(F.count("*").alias("n")))
    words = pairs.groupBy("toxic", "w").agg(F.count("*").alias("n")).toArrow()
    toxic = words["toxic"].to_numpy()
    if not (toxic == 0).any() or not (toxic == 1).any():
        forget(pairs)
        return float(toxic.any())
    model = Model(words, pairs.groupBy("toxic", "v").agg(F.sum("n").alias("n")).toArrow(), pairs.where(F.col("n") > PAIR_DISCOUNT).toArrow())
    forget(pairs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([shipped.value.evidence(t, PARTS) for t in texts_of(batch)], pa.list_(pa.float64()))], names=["toxic", "x"])

    held = own.where(apart).select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").toArrow()
    y = held["toxic"].to_numpy()
    if (y == 0).any() and (y == 1).any():
        model.calibrate(np.array(held["x"].to_pylist()).T, y)
    else:
        model.slope = 10.0
    return model


def toxicity(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS) -> DataFrame:
    """All columns of docs and toxicity, a double from 0 to 1."""
    model = fit(docs, labels, docs_per_class)
    if isinstance(model, float):
        return docs.withColumn("toxicity", F.lit(model))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = shipped.value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.score(m.evidence(t)[0]) for t in texts_of(batch)], pa.float64())], names=[*batch.schema.names, "toxicity"])

    docs = docs.drop("toxicity")
    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("toxicity")).schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(crc_mod(FOLDS) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
