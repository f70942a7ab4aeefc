"""Tokens found on whole columns are those of tokens_of, and partial sums stay exact and small."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from recall_spark.llm import lm


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_tokens_of_columns(kind):
    texts = ["", None, " ", "A  b\tC\nd\x0be\x0cf\rg ", "x\x1cy\x1fz\x85q", "É é  ÀB", "a\0b", "\n\nlast", *[chr(c).join("ab") for c in range(256)]]
    words, at, sizes = lm.dealt(pa.array(texts, kind))
    got, ends = [lm.END] * sizes.sum(), np.cumsum(sizes)
    for i, w in zip(at, words.to_pylist(), strict=True):
        got[i] = w
    assert [got[e - n : e] for e, n in zip(ends, sizes, strict=True)] == [lm.tokens_of((t or "").encode()) for t in texts]
    assert [len(n) for _, n in lm.parts(np.arange(sizes.sum()), sizes, 4)][:3] == [3, 1, 1] and sum(len(i) for i, _ in lm.parts(np.arange(sizes.sum()), sizes, 4)) == sizes.sum()


def test_numbers_of_words():
    words = lm.Words(lm.Model([b"the"], 2, 3, 9))
    for texts in (["b a b", None], ["a c", "c"], ["b"]):
        ids, sizes = words.ids(pa.array(texts))
        want = [t for x in texts for t in lm.tokens_of((x or "").encode())]
        assert [words.known[int(i)].as_py() for i in ids] == want and sizes.sum() == len(want)
    assert len(words.known) == 4 and (words.h == lm.hashes(words.known.to_pylist())).all()


def test_partial_sums_are_exact_and_small():
    taken, n = np.array([1, (1 << 24) + 1, 0], np.int32), np.array([2, (1 << 24) + 3, 0], np.int32)
    got = lm._whole(lm._sum_row(1, 0, taken, np.array([0.25, 0.5, 0], np.float32), n)["sums"][0].as_buffer(), 1)
    assert got.tolist() == [1, (1 << 24) + 1, 0, 0.25, 0.5, 0, 2, (1 << 24) + 3, 0]  # in float32 the counts were off by one
    model = lm.Model([b"the"], 40, 9, 900)

    class Shipped:
        value = model

    texts = pa.record_batch({"text": pa.array([" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(400)])})
    rows = [r["sums"][0].as_buffer() for r in lm._sums(Shipped)([texts]) if r["kind"][0].as_py() == 0]
    step = lm.SLAB // model.classes
    size = len(lm._whole(rows[0], 0)) // (model.classes + 1)
    assert size == step
    counts = [lm._whole(r, 0) for r in rows]
    split = [len(c) // (model.classes + 1) * model.classes for c in counts]
    assert sum(c[:k].sum() for c, k in zip(counts, split, strict=True)) == sum(c[k:].sum() for c, k in zip(counts, split, strict=True)) == 4 * 400 * 51
    plain = sum(len(zlib.compress(c.astype(np.float32).tobytes(), 1)) for c in counts)
    assert sum(len(zlib.compress(r, 1)) for r in rows) < 0.9 * plain
