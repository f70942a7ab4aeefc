"""Null and repeated ids, very long texts, ties and clashing columns: defined results, no lost rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from recall_spark.llm import bpe, fingerprints, language, lm, near, packing, quality, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["to", "mark", "doc", "body", "spans", "fp", "key", "node", "kept", "toxicity", "lang_pred", "lang_score", "lang_fits", "n_bytes", "kept_text", "block", "h", "_text"]
PASSAGE = "a passage of more than fifty bytes that several documents of this table have in common"


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"word{i % 977} thing{i}" for i in range(60_000))  # about 1 MB
    return [
        (1, "one " + PASSAGE, "en", "a", 1), (1, "one " + PASSAGE, "en", "a", 1), (1, "another text, " + PASSAGE, "en", "b", 1),
        (None, "no id, " + PASSAGE, "en", None, 1), (None, "no id, " + PASSAGE, None, "a", 1), (None, None, None, None, None),
        (2, long, "en", "a", 1), (3, long, "fr", "a", 1), (4, None, "en", "c", None), (5, "", "en", "c", 0), (6, PASSAGE, "en", "c", 1), (7, PASSAGE.upper(), "en", "c", 1),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2).cache()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))


def kept(rows):
    """What is left of each row: a null id is larger than all, rows of one id aren't smaller than each other."""
    order = lambda d: (d is None, d or 0)
    out = []
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    windows = [{t[i : i + 50] for i in range(len(t) - 49)} if len(t) < 10_000 else t for _, t in texts]
    for d, t in texts:
        smaller = [w for (e, _), w in zip(texts, windows, strict=True) if order(e) < order(d)]
        if len(t) >= 10_000:
            out.append(b"" if any(w is t or w == t for w in smaller) else t)
            continue
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if any(t[i : i + 50] in w for w in smaller):
                gone[i : i + 50] = b"\1" * 50
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


def test_repeats(docs, wide, rows):
    want = Counter((d, hashlib.sha256(x).hexdigest()) for (d, *_), x in zip(rows, kept(rows), strict=True))
    for table in (docs, wide):
        got = substrings.without_repeats(table)
        assert Counter((r.doc_id, r.kept_sha256) for r in got.select("doc_id", "kept_sha256").collect()) == want
        assert set(table.columns) <= set(got.columns)
    assert got.where("spans <> 4 or node <> 7").count() == 0  # the input's own columns


def test_toxicity(spark, wide, rows):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 1, 0), (2, 1, 0), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(wide, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.toxicity <= 1 for r in got)
    assert len({r.toxicity for r in got if not r.text}) == 1


def test_near(docs, wide, rows):
    got = near.near_groups(wide).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.component_id for r in got if r.doc_id in (2, 3)} == {2} and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    groups = near.similar_groups(wide).collect()
    assert Counter(r.doc_id for r in groups) == Counter(r[0] for r in rows) and len({r.component for r in groups if r.doc_id in (2, 3)}) == 1


def test_quality(wide, rows):
    got = quality.judged(wide, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(not r.kept and r.base_failed for r in got if r.n_words < 10)


def test_scores(wide, rows):
    got = lm.scores(wide).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(r.score < 0 and r.base_score < 0 for r in got)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (4, 5)) and all(r.held_out is not None for r in got)


def test_languages(wide, rows):
    got = language.languages(wide).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all((r.lang_pred == "und") == (not r.text) for r in got) and all(r.key == CLASHING.index("key") for r in got)


def test_bpe(wide, rows):
    assert Counter(r.doc_id for r in bpe.encoded(wide).select("doc_id").collect()) == Counter(r[0] for r in rows)


def test_packing(wide, docs, rows):
    pieces = packing.pack(wide).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r[0] for r in rows)


def test_fingerprints(wide, rows):
    got = fingerprints.document_fingerprints(wide).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1 and {r.n_within for r in got if r.doc_id in (4, 5)} == {3}


def test_pipeline_stages_keep_what_they_should(spark, wide, rows, tmp_path):
    import corpus_pipeline

    found = corpus_pipeline.keep_one_of_each_group(spark, wide, "").collect()
    texts = Counter((r.text or "") for r in found)
    assert max(texts.values()) == 1 and {r.doc_id for r in found if r.text and len(r.text) > 10_000} == {2}
    left = corpus_pipeline.cut_repeats(spark, wide, "").collect()
    assert Counter(r.doc_id for r in left) == Counter(r[0] for r in rows) and all(r.n_chars == len(r.text) for r in left)
    assert {r.text for r in corpus_pipeline.drop_unknown_language(spark, wide, "").collect()} >= {PASSAGE}
