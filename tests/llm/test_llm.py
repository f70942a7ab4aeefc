"""Training-data operators against brute force, on a small table with odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recall_spark.llm import bpe, fingerprints, language, lm, near, packing, quality, rollup, substrings, toxicity
from recall_spark.llm.components import components
from recall_spark.llm.suffixes import suffix_arrays

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    base = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 120").fetchall()
    long = base[3][1]
    odd = [(9001, None, None, None, 0), (9002, "", "en", "src1", 0), (9003, " \n\t ", "en", None, 4), (9004, "…!? 123 <|endoftext|> x", None, "src1", 0), (9005, long, "en", "src1", 0), (9006, "ab é" + long + " 漢字 tail", "fr", "src2", 0), (9007, "the same words " * 300, "en", "src2", 0)]
    return base + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


def words(text):
    return re.findall(WORD, text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(3)
    for letters, n in ((1, 9), (2, 16), (3, 33), (26, 60)):
        sym = rng.integers(1, letters + 1, (150, n)).astype(np.int16)
        for r in range(150):
            sym[r, n - rng.integers(1, n // 2) :] = 0
        got = suffix_arrays(sym)
        assert all(got[r].tolist() == sorted(range(n), key=lambda i, r=r: sym[r, i:].tolist()) for r in range(150))


def test_removed_spans(docs, rows, empty):
    seen, want = set(), {}
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), []
        for i in range(len(raw) - 49):
            if raw[i : i + 50] in seen:
                gone[i : i + 50] = b"\1" * 50
            own.append(raw[i : i + 50])
        seen.update(own)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[d] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    assert by_id(substrings.without_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert substrings.without_repeats(empty).count() == 0


def test_removed_spans_with_hot_anchors(docs):
    """Anchors with more than a few contexts are dealt by window, with the same result."""
    cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert by_id(substrings.without_repeats(docs, many=3, local=1), *cols) == by_id(substrings.without_repeats(docs), *cols)


def test_windows_of_one_anchor_are_compared_byte_by_byte():
    rng = np.random.default_rng(5)
    core = bytes(rng.integers(97, 123, 16).astype(np.uint8))
    for n in (60, 400):  # the larger group is split
        bodies = [bytes(rng.choice([97, 98], 34).astype(np.uint8)) + core + bytes(rng.choice([97, 98], 34).astype(np.uint8)) for _ in range(n)]
        s = substrings.Strings(np.array([[34] * n, [84] * n], np.uint8), np.frombuffer(b"".join(bodies), np.uint8))
        doc, got = np.arange(n), set()
        for single, *pieces in substrings._strings(s, np.zeros(n, np.uint64)):
            for k, d in [substrings._equal(s, doc, *pieces[:2], pieces[3])] if single else substrings._later(s, doc, *pieces):
                got |= set(zip(k.tolist(), d.tolist(), strict=True))
        seen, want = set(), set()
        for i, b in enumerate(bodies):
            want |= {(i, 34 - j) for j in range(35) if b[j : j + 50] in seen}
            seen |= {b[j : j + 50] for j in range(35)}
        assert got == want


def test_near_groups(docs, rows, empty):
    def fp(text):
        w = words(ascii_lower(text))
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {r[0]: fp(r[1]) for r in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(near.near_groups(docs).withColumn("h", F.lpad(F.lower(F.hex("fp")), 16, "0")), "h", "component_id")
    assert got == {d: (f"{fps[d]:016x}", find(d)) for d in ids}
    assert near.near_groups(empty).count() == 0


def test_crowded_keys_are_cut_without_losing_links(spark, docs):
    want = {tuple(r) for r in near.near_groups(docs).collect()}
    assert {tuple(r) for r in near.near_groups(docs, crowd=1).collect()} == want


def test_similar_groups_find_planted_copies(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, sets = [], {}

    def put(words):
        rows.append((len(rows), " ".join(words)))
        sets[len(rows) - 1] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    for n in (30, 60, 120, 250, 600, 1500):
        for _ in range(8):
            base = list(rng.choice(vocabulary, n))
            put(base)
            for k in range(1, 4):  # copies with some words replaced
                copy = list(base)
                for i in rng.choice(n, max(1, n * k // 130), replace=False):
                    copy[i] = str(rng.choice(vocabulary))
                put(copy)
    rows += [(None, None), (None, ""), (9000, rows[0][1]), (9000, rows[5][1]), (9001, "one"), (9002, "one two three four five")]
    got = near.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    group = {r.doc_id: r.component for r in got if r.doc_id is not None and r.doc_id < 9000}
    assert len({r.component for r in got if r.doc_id is None}) == 1
    assert {r.component for r in got if r.doc_id == 9000} == {group[0], group[5]}
    similar = [(i, j) for i in sets for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(similar) > 60 and sum(group[i] != group[j] for i, j in similar) <= len(similar) // 50
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in similar:
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i in sets for j in range(i) if group[i] == group[j])  # nothing else is linked


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 7), *((100 + i, 101 + i) for i in range(40)), *((500, 600 + i) for i in range(50))]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in (1, 2, 3)} == {1} and got[9] == 7 and {got[i] for i in range(100, 141)} == {100} and {got[600 + i] for i in range(50)} == {500}


def test_base_counts_and_verdict(docs, rows, empty):
    want = {}
    for d, text, *_ in rows:
        text, w, seen = text or "", words(text), {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        want[d] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))
    found = quality.judged(docs, ["doc_id"])
    assert by_id(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    kept = by_id(found, "kept")
    assert not kept[9001][0] and not kept[9007][0] and kept[9005][0] == kept[rows[3][0]][0]
    assert quality.judged(empty, ["doc_id"]).count() == 0


def test_em_against_a_version_over_documents(monkeypatch):
    rng, groups = np.random.default_rng(5), [[0, 1], [2], [3, 4]]
    chances = {0: [0.05, 0.05, 0.1, 0.02, 0.1], 1: [0.8, 0.9, 0.2, 0.1, 0.1], 2: [0.1, 0.1, 0.7, 0.9, 0.8]}
    docs = [tuple(-1 if rng.random() < x else int(rng.random() < 0.6) for x in chances[k]) for k in rng.choice(3, 900, p=[0.7, 0.2, 0.1])]
    patterns = sorted(({(-1, -1, -1, -1, -1): 0} | Counter(docs)).items())
    start = quality.beginning(patterns, quality.seeds(patterns))
    m, codes = np.array([start[d] for d in docs]), [np.array([sum((d[r] + 1) * 3**i for i, r in enumerate(g)) for d in docs]) for g in groups]
    for _ in range(40):
        weight = np.log((m.sum(0) + quality.PRIOR) / (len(docs) + quality.PRIOR * m.shape[1]))
        each = np.tile(weight, (len(docs), 1))
        for g, code in zip(groups, codes):
            table = np.array([np.bincount(code, m[:, c], 3 ** len(g)) for c in range(m.shape[1])]) + quality.PRIOR / 3 ** len(g)
            each += np.log(table / (m.sum(0) + quality.PRIOR)[:, None])[:, code].T
        m = np.exp(each - each.max(1, keepdims=True))
        m /= m.sum(1, keepdims=True)
    monkeypatch.setattr(quality, "STILL", -1.0)
    got = quality.estimate(patterns, groups, 40)
    assert len(quality.seeds(patterns)) > 1 and np.allclose([got[d] for d in docs], m[:, 0])
    assert quality.estimate([((1, 0, -1, 0, 0), 5), ((-1, -1, 0, 0, 0), 0)], groups) == {(1, 0, -1, 0, 0): 1.0, (-1, -1, 0, 0, 0): 1.0}


def test_em_is_no_worse_than_its_start(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged = quality.judged(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), ["doc_id"]).join(labels, "doc_id").where("not base_failed")
    start = F.aggregate(F.array(*[F.col(f"vote_{r}") for r in quality.RULES]), F.lit(0), lambda n, v: n + (v < 0).cast("int")) < 2
    wrong = {k: judged.where(c.cast("int") != F.col("quality")).groupBy("quality").count().collect() for k, c in (("start", start), ("end", F.col("kept")))}
    start, end = ({r.quality: r["count"] for r in wrong[k]} for k in ("start", "end"))
    assert all(end.get(q, 0) <= start.get(q, 0) for q in (0, 1)) and sum(end.values()) < sum(start.values())


def test_toxicity_on_held_out(spark):
    got = toxicity.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("hit"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert r.hit > 0.4 and r.false < 0.1, r


def test_toxicity_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    scores = by_id(toxicity.toxicity(docs, labels), "toxicity")
    assert len(scores) == docs.count() and all(0 <= s[0] <= 1 for s in scores.values()) and scores[9001] == scores[9002]
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("toxic = 0")).where("toxicity > 0").count() == 0


def test_languages(spark, docs, empty):
    got = by_id(language.languages(docs), "lang_pred", "lang_score", "lang")
    assert all(got[i][:2] == ("und", 0.0) for i in (9001, 9002, 9003))
    right = [p == lang for p, _, lang in got.values() if lang and p != "und"]
    assert sum(right) / len(right) > 0.95
    assert language.languages(empty).count() == 0


def test_cross_parsing_counts_longest_phrases():
    rng = np.random.default_rng(2)
    learnt = {k: "".join(rng.choice(list(letters), 900)) for k, letters in (("a", "abcde"), ("b", "defgh "), ("c", "aé漢"))}
    p = language.Parser({k: [t] for k, t in learnt.items()})
    tab = p.table()
    texts = ["", "abcd", "zz1z", *("".join(rng.choice(list("abcdefghé漢z "), n)) for n in (3, 511, 512, 513, 2000)), learnt["a"] * 3, "".join(rng.choice(list("abc"), 3000))]
    parts = [language._symbols(t, tab) for t in texts]

    def count(ids, own):
        n = i = 0
        while i < len(ids):
            k = 1
            while i + k < len(ids) and "".join(map(chr, ids[i : i + k + 1] + 50)) in own:
                k += 1
            n, i = n + 1, i + k
        return n

    own = ["".join(chr(x + 50) for x in [*(x for x in language._symbols(learnt[k], tab).tolist() if x != 1), 0]) for k in p.langs]
    assert p.phrases(parts).tolist() == [[count(ids, o) for o in own] for ids in parts]


def test_bpe_is_exact(docs, rows, empty):
    enc = bpe.Encoder(bpe.vocabulary("word_bpe_49k.json"))
    want = {}
    for d, text, *_ in rows:
        ids = enc.tok.encode(text or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert by_id(bpe.encoded(docs), "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encoded(empty).count() == 0


def test_packing_loses_nothing(docs, rows, empty):
    enc = packing.ByteEncoder(packing.vocabulary("byte_bpe_50k.json"), packing.vocabulary("byte_bpe_50k.tiktoken"))
    ids = {d: enc.tok.encode(text or "", add_special_tokens=False).ids + [0] for d, text, *_ in rows}
    at, sequences = Counter(), {}
    for r in sorted(packing.pack(docs).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert dict(at) == {d: len(x) for d, x in ids.items()}
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    assert packing.pack(empty).count() == 0


def test_windows_hold_the_mixture():
    queues = {"a": [(0, 40_000)], "b": [(1, 10_000)], "c": [(2, 5_000), (3, 5_000)]}
    windows = list(packing.fill(queues, {"a": 2 / 3, "b": 1 / 6, "c": 1 / 6}, {}))
    for w in windows[:-3]:
        assert abs(sum(n for d, _, n in w if d == 0) - 683) <= 34


def test_scores(docs, rows, empty):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    tokens = {d: [*words(ascii_lower(text)), ""] for d, text, *_ in rows}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    total, kinds = sum(c.values()), len(c)
    got = by_id(lm.scores(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, t in tokens.items():
        base = sum(np.log10((c[w] + 1) / (total + kinds + 1)) for w in t)
        assert got[d][:4] == (held[d], len(t), sum(c[w] > 0 for w in t), total) and got[d][4] == pytest.approx(base, rel=1e-9)
    out = [d for d in tokens if held[d]]
    assert sum(got[d][5] for d in out) > sum(got[d][4] for d in out)
    assert lm.scores(empty).count() == 0


def test_scores_learn_from_every_document_and_inside_classes(spark):
    ids = [r.id for r in spark.range(2000).orderBy(F.xxhash64("id"), "id").collect()]
    filler = " ".join(f"w{i:02d} w{i:02d}" for i in range(30))
    rows = [(d, filler if k < 800 else filler + (" left seeing", " right baking")[k % 2]) for k, d in enumerate(ids)]
    same, other = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % lm.FOLDS == lm.HELD_OUT][:2]
    got = by_id(lm.scores(spark.createDataFrame([*rows, (same, "left seeing"), (other, "left baking")], "doc_id long, text string")), "base_score", "score")
    assert got[same][1] - got[same][0] > got[other][1] - got[other][0] + 0.5


def test_document_fingerprints(docs, rows, empty):
    def fp(text):
        votes, n = [0] * 64, 0
        for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
            k, h = min(12, len(w)), xxhash.xxh64_intdigest(w.encode(), 42)
            n += k
            votes = [v + k * (h >> b & 1) for b, v in enumerate(votes)]
        return sum(1 << b for b in range(64) if 2 * votes[b] > n)

    texts = {d: text or "" for d, text, *_ in rows}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    fps, want = {d: fp(t) for d, t in texts.items()}, {}
    for d, t in texts.items():
        k = len(t) // 2
        edited = t[: len(t) - k] + texts[after[d]][:k]
        e = fp(edited)
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[d]:016x}", f"{e:016x}", 1 - (fps[d] ^ e).bit_count() / 64, 1 - (fps[d] ^ fps[after[d]]).bit_count() / 64)
    assert by_id(fingerprints.document_fingerprints(docs), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == want
    near_by = {d: (sum((fps[d] ^ x).bit_count() <= 3 for x in fps.values()),) for d in fps}
    assert by_id(fingerprints.document_fingerprints(docs), "n_within") == near_by
    assert fingerprints.document_fingerprints(empty).count() == 0


def test_within_finds_all(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    all_ = {int(b) for b in base} | {int(b) ^ sum(1 << int(k) for k in rng.choice(63, 3, replace=False)) for b in base}
    df = spark.createDataFrame([(x,) for x in all_], "fp long")
    got = {(r.query_fp, r.fp) for r in fingerprints.within(df, df, 3).collect()}
    assert got == {(a, b) for a in all_ for b in all_ if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_rollup_counts_a_batch_once(spark, tmp_path):
    log = rollup.Rollup(spark, f"file://{tmp_path}/log")
    assert log.totals().count() == 0
    rows = spark.createDataFrame([("s", "en", "words-1", 1, 5), (None, None, "words-1", 1, 2)], rollup.SCHEMA)
    assert log.commit("a", rows) and not log.commit("a", rows) and log.compact()
    rows.write.parquet(f"file://{tmp_path}/log/sums/interrupted")  # no marker names it
    assert log.commit("b", rows.where("source is null").withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))
    assert [tuple(r) for r in log.totals().collect()] == [("s", "en", "words-1", 1, 5)]
    assert log.compact() and not log.compact() and [tuple(r) for r in log.totals().collect()] == [("s", "en", "words-1", 1, 5)]
    assert not log.commit("a", rows) and log.batches() == ["a", "b"]


def racing(log, step, other):
    """Runs other in the middle of the log's next call of step."""
    own, waiting = getattr(log, step), [other]

    def call(*args):
        if waiting:
            waiting.pop()()
        return own(*args)

    setattr(log, step, call)


ROWS = "doc_id long, source string, lang string, tokenizer string, tokens long"


def test_rollup_with_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log, other = rollup.Rollup(spark, path), rollup.Rollup(spark, path)
    rows = lambda *r: spark.createDataFrame(list(r), ROWS)
    log.apply("0", rows((1, "a", "en", "t", 5)))
    racing(log, "totals", lambda: other.apply("1", rows((2, "a", "en", "t", 5))))
    assert log.compact() and [tuple(r) for r in log.totals().collect()] == [("a", "en", "t", 2, 10)]
    racing(log, "_publish", lambda: other.apply("2", rows((1, "a", "en", "t", 6))))
    assert log.apply("3", rows((1, "b", "en", "t", 7)))
    assert {tuple(r) for r in log.totals().collect()} == {("a", "en", "t", 1, 5), ("b", "en", "t", 1, 7)}
    racing(log, "_publish", lambda: other.apply("4", rows((1, "b", "en", "t", 9))))
    assert not log.apply("4", rows((1, "b", "en", "t", 9))) and log.batches() == ["0", "1", "2", "3", "4"]
    racing(log, "_publish", lambda: other.commit("5", spark.createDataFrame([("c", None, "t", 1, 1)], rollup.SCHEMA)))
    assert log.commit("6", spark.createDataFrame([("c", None, "t", 1, 2)], rollup.SCHEMA))
    want = {("a", "en", "t", 1, 5), ("b", "en", "t", 1, 9), ("c", None, "t", 2, 3)}
    racing(log, "_publish", lambda: other.compact())
    assert {tuple(r) for r in log.totals().collect()} == want and not log.compact()
    log.clean()
    log = rollup.Rollup(spark, path)
    assert {tuple(r) for r in log.totals().collect()} == want
    assert log.apply("7", deletes=rows((1, None, None, None, 0)).select("doc_id")) and {tuple(r) for r in log.totals().collect()} == want - {("b", "en", "t", 1, 9)}
    assert len(list((tmp_path / "log" / "sums").iterdir())) == 1 and len(list((tmp_path / "log" / "ledger").iterdir())) == 1


def test_counts_of_odd_texts(spark):
    schema = "doc_id long, text string, lang string, source string, tokenizer string"
    docs = spark.createDataFrame([(1, None, "en", "s", "x"), (2, "", None, None, "x"), (3, "word " * 200_000, "en", "s", "x"), (None, "word", "en", "s", "x"), (3, "word", "en", "s", "x")], schema)
    got = sorted(((r.doc_id or 0, r.tokenizer, r.tokens) for r in rollup.counted(docs, "byte-50k").collect()), key=lambda r: (r[0], r[2]))
    assert [r[:2] for r in got] == [(i, "byte-50k") for i in (0, 1, 2, 3, 3)] and [r[2] for r in got[:4]] == [1, 0, 0, 1] and got[4][2] >= 200_000
    assert rollup.counted(docs.limit(0), "byte-50k").count() == 0


def test_rollup_looks_up_what_documents_count_as(spark, tmp_path):
    log = rollup.Rollup(spark, f"file://{tmp_path}/log")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, source string, lang string, tokenizer string, tokens long")
    ids = lambda *r: spark.createDataFrame([(x,) for x in r], "doc_id long")
    log.apply("0", rows((1, "a", "en", "t", 5), (2, "a", "en", "t", 7), (2, "a", "en", "t", 1), (None, "b", None, "t", 3)))
    log.apply("1", rows((2, "b", "fr", "u", 9), (4, "a", "en", "t", 2)), ids(1, 99, None))
    log.apply("1", rows((2, "b", "fr", "u", 100)))
    log.apply("2", rows(), ids())
    assert {tuple(r) for r in log.totals().collect()} == {("a", "en", "t", 1, 2), ("b", None, "t", 1, 3), ("b", "fr", "u", 1, 9)}
    log.apply("3", rows((1, "a", "en", "t", 6)), ids(2))
    assert {tuple(r) for r in log.totals().collect()} == {("a", "en", "t", 2, 8), ("b", None, "t", 1, 3)}


def test_token_counts_against_brute_force(spark):
    import base64

    import public_tokenizers
    import tiktoken

    def encoder(name):
        with open(public_tokenizers.path(name), "rb") as f:
            return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={}).encode_ordinary

    encode = {v: encoder(f) for v, f in rollup.TOKENIZERS.items()}
    docs = duckdb.sql(f"SELECT source, lang, text FROM '{SF}/documents.parquet' WHERE doc_id NOT IN (SELECT doc_id FROM '{SF}/labels.parquet' WHERE toxic = 1)").fetchall()
    want = Counter()
    for source, lang, text in docs:
        version = "byte-50k" if lang == "en" else "byte-multi-50k"
        want[source, lang, version, "docs"] += 1
        want[source, lang, version, "tokens"] += len(encode[version](text or ""))
    got = {(r.source, r.lang, r.tokenizer, k): r[k] for r in rollup.op5_token_counts(spark, SF).collect() for k in ("docs", "tokens")}
    assert got == dict(want)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    now, ids = docs.withColumn("fp", F.lit(1)), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert now.columns == corpus_pipeline.COLUMNS
            new = {r.doc_id for r in now.select("doc_id").collect()}
            assert ids is None or new <= ids
            ids = new
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == ids and 9001 not in ids and 9005 not in ids


def test_similar_groups_lose_no_link(spark):
    """Families around the least similarity, long and short, and sets whose common words hide what they share."""
    rng = np.random.default_rng(11)
    vocabulary, rows, sets = [f"w{i}" for i in range(4000)], [], {}
    for n in (6, 9, 14, 24, 40, 90, 200, 700):
        for _ in range(12):
            base = [str(w) for w in rng.choice(vocabulary, n)]
            for k in range(6):
                copy = list(base)
                for i in rng.choice(n, round(n * 0.025 * rng.uniform(0.3, 1.1)), replace=False) if k else []:
                    copy[i] = str(rng.choice(vocabulary))
                if k > 3:  # words more at the end
                    copy += [str(w) for w in rng.choice(vocabulary, int(n * rng.uniform(0, 0.3)))]
                rows.append((len(rows), " ".join(copy)))
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
    similar = [(i, j) for i in sets for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in similar:
        root[find(i)] = find(j)
    for crowd in (near.CROWD, 2):
        group = {r.doc_id: r.component for r in near.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd).collect()}
        assert len(similar) > 200 and [(i, j) for i, j in similar if group[i] != group[j]] == []
        assert len(set(group.values())) == len({find(i) for i in sets})
