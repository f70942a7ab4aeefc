"""Words' decisions are found as runs of places, and training works them out a piece at a time."""

import numpy as np
import pyarrow as pa

from recall_spark.llm import lm


def grown(names, counts, least):
    """A model whose tree has been decided from words and their counts."""
    model = lm.Model(names[:2], 3, len(names), sum(counts))
    h = lm.hashes(names)
    classes = model.classes_of(names, h)
    got = lm._node_mass(least)(pa.table({"class": classes, "h": h.view(np.int64), "mass": np.array(counts) + 1.0}))
    node, mass, ones = (got[c].to_numpy() for c in ("node", "mass", "ones"))
    order = np.argsort(node)
    node, mass, ones = node[order], mass[order], ones[order]
    split = (mass >= least) & (ones > 0) & (ones < mass)
    model.decide(node[split], np.log(ones[split] / (mass[split] - ones[split])).astype(np.float32))
    return model


def test_paths_are_the_nodes_above_a_word():
    names = [f"w{i * i}".encode() for i in range(900)]
    model = grown(names, [1 + i % 7 for i in range(900)], 9.0)
    assert model.deepest > 5
    depths = {int(x): i for i, x in enumerate(model.nodes)}
    assert any(n >> 1 & ((1 << 31) - 1) and (n >> 32 << 32 | (n & ((1 << 32) - 1)) >> 1) not in depths for n in depths if n & ((1 << 32) - 1) > 1)  # nodes whose parent decides nothing
    asked = [*names[::-3], b"", b"unseen", b"unseen", b"\xff\0", *(f"z{i}".encode() for i in range(300))]
    h = lm.hashes(asked)
    classes = model.classes_of(asked, h)
    n, nodes, taken, starts = model.paths(classes, h)
    for i in range(len(asked)):
        want = [(depths[k], bool(int(h[i]) >> 63 - d & 1)) for d in range(lm.DEPTH) if (k := int(lm.node_keys(classes[i : i + 1], h[i : i + 1], d)[0])) in depths]
        assert list(zip(nodes[starts[i] : starts[i] + n[i]].tolist(), taken[starts[i] : starts[i] + n[i]].tolist(), strict=True)) == want
    assert n.sum() == len(nodes) == len(taken) and all(len(x) == 0 for x in model.paths(classes[:0], h[:0]))
    bare = lm.Model([], 1, 0, 0)
    assert [x.tolist() for x in bare.paths(classes[:2], h[:2])] == [[0, 0], [], [], [0, 0]]


def test_training_works_out_a_piece_at_a_time(monkeypatch):
    names = [f"w{i}".encode() for i in range(60)]
    model = grown([lm.END, *names], [200, *range(1, 61)], 9.0)
    seen, decisions = [], lm.Model.decisions

    def watched(self, mixed, words, paths):
        seen.append(len(words))
        return decisions(self, mixed, words, paths)

    monkeypatch.setattr(lm.Model, "decisions", watched)
    monkeypatch.setattr(lm, "CHUNK", 64)

    class Shipped:
        value = model

    texts = pa.record_batch({"text": pa.array([" ".join(f"w{(i * j) % 60}" for j in range(30)) for i in range(40)] + [None, ""])})

    def sums():
        return [(r["kind"][0].as_py(), r["slab"][0].as_py(), lm._whole(r["sums"][0].as_buffer(), r["kind"][0].as_py())) for r in lm._sums(Shipped)(iter([texts]))]

    small = sums()
    assert max(seen) == 64 and sum(seen) == 40 * 31 + 2  # all tokens of a part at once before
    monkeypatch.setattr(lm, "CHUNK", 1 << 20)
    for (kind, slab, got), want in zip(small, sums(), strict=True):
        assert (kind, slab) == want[:2] and np.allclose(got, want[2], atol=1e-5)


def test_unlikely_decisions_cost_what_they_cost_in_double():
    z = np.array([-80, -30, -3, 0, 3, 30, 80], np.float32)
    got = np.log(np.exp(z) + np.float32(1))
    assert got.dtype == np.float32 and np.allclose(got, np.logaddexp(0, z.astype(float)), rtol=1e-6, atol=1e-6)


def test_training_lets_words_go(monkeypatch):
    names = [f"w{i}".encode() for i in range(60)]
    model = grown([lm.END, *names], [200, *range(1, 61)], 9.0)

    class Shipped:
        value = model

    texts = pa.record_batch({"text": pa.array([" ".join(f"w{(i * j) % 60}" for j in range(30)) for i in range(40)])})

    def sums():
        return [r["sums"][0].as_py() for r in lm._sums(Shipped)(iter([texts]))]

    whole = sums()
    monkeypatch.setattr(lm, "KEPT_WORDS", 5)
    monkeypatch.setattr(lm, "PIECE_BYTES", 300)
    assert sums() == whole
