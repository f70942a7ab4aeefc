"""Collocations against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from recall_spark.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, longest, top, replaces):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {}
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                found[p] = (a, *min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))))
        gone = {p[i : i + m] for p, x in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if p[i : i + m] in found and 100 * x[0] >= replaces * found[p[i : i + m]][0]}
        kept = sorted(((-s, -a, " ".join(p).encode(), l, r) for p, (a, s, _, l, r) in found.items() if p not in gone))[:top]
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(kept)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocabulary = ["The", "of", "thing", "né", "漢字", "a", "to", "x-y", "\u00a0", "in"]
    made = [(" ".join(vocabulary[i] + ("" if rng.random() < 0.8 else rng.choice([".", ", ", "!\n", "\t"])) for i in np.minimum(rng.geometric(0.3, rng.integers(0, 60)) - 1, 9)), str(rng.choice(["en", "de"]))) for _ in range(150)]
    odd = [(None, "en"), ("", None), (" \t .;", "en"), ("the end of the end of the end", None), ("THE THE THE THE THE THE", "en"), ("of the thing " * 30_000, "fr"), made[3], made[3]]
    return made + odd


@pytest.mark.parametrize(("least", "top", "replaces", "segment"), [(5, 2000, 100, 8_000_000), (3, 7, 90, 300), (2, 40, 100, 1)])
def test_against_brute_force(spark, rows, monkeypatch, least, top, replaces, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    docs = spark.createDataFrame([(t, x, 1, "q") for t, x in rows], "text string, lang string, seg long, fp string").repartition(3)
    got = C.collocations(docs, least, 5, top, replaces)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 5, top, replaces)


def test_phrases_that_share_a_fingerprint(spark, rows, monkeypatch):
    """With fingerprints of two bits nearly all phrases collide; the words decide."""
    docs = spark.createDataFrame([(t, x) for t, x in rows if not t or len(t) < 1000], "text string, lang string").coalesce(1)
    own = C.Segment.fingerprints
    segment = C.Segment(b"the end of the end of the end of it", np.array([0]), np.array([0], np.int32), ["en"])
    monkeypatch.setattr(C.Segment, "fingerprints", lambda self, at, n: own(self, at, n) & np.uint64(3))
    found = {}
    for _, counts, at in segment.counted(segment.inside(2), 2):
        found |= {segment.phrase(p, 2): c for p, c in zip(at.tolist(), counts.tolist(), strict=True)}
    assert found == {"the end": 3, "end of": 3, "of the": 2, "of it": 1}
    monkeypatch.undo()
    assert docs.count()


def test_prefix_polynomials():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    start = rng.integers(0, 45, 20)
    got = C.polynomials(v, start, start + 5)
    assert got.tolist() == [sum(int(v[s + j]) * pow(C._BASE, j, 1 << 64) for j in range(5)) % (1 << 64) for s in start]


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
