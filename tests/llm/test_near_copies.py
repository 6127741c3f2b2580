"""Near-duplicates of the pipeline against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rdfloom.llm import simhash

DOCS = "doc_id long, text string, kept string"


def brute(texts):
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_near_copies_of_the_pipeline(spark):
    """Copies at a Jaccard similarity of 0.8 and more, in groups, through small buckets (second pass) too."""
    rng = random.Random(11)
    texts = [None, "", "one two", "ONE  two", "a b c d e", "a b c d f"]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5, 8, 12):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    want = brute(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))
    assert simhash.representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4, 2048])
def test_dense_groups_of_near_copies(spark, bucket):
    rng = random.Random(3)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    want = brute(texts)
    got = defaultdict(set)
    for r in simhash.similar(docs, bucket=bucket).collect():
        got[r.root].add(r.doc_id)
    assert sorted(map(min, got.values())) == sorted(set(want))
    for g in got.values():
        assert len({want[i] for i in g}) == 1


def test_families_are_joined_exactly():
    """Edges of a block connect the same members as all its near pairs do, and stay within them."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        sets = []
        for _ in range(4):
            base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
            sets += [np.unique(np.where(rng.random(40) < rng.random() * 0.2, rng.integers(0, 1 << 62, 40, dtype=np.uint64), base)) for _ in range(8)]
        m = np.array([simhash.margins(x) for x in sets])
        lo, hi = np.packbits(m > 0, axis=1, bitorder="little").view(np.int64).T.copy()
        most, n = simhash.max_distance(0.8), len(sets)
        d = simhash._distances(lo, hi)
        alike = lambda i, j: d[i, j] <= most and len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 0.8 * len(set(sets[i].tolist()) | set(sets[j].tolist()))
        root = np.arange(n) // 2 * 2  # some are joined already
        edges = simhash._joined(np.arange(n), root, lo, hi, [x.view(np.int64) for x in sets], most, 0.8)
        assert all(alike(i, j) and root[i] != root[j] for i, j in edges) and len(edges) < n

        def connected(pairs):
            label = root.copy()
            for _ in range(n):
                for i, j in pairs:
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
            return label.tolist()

        assert connected(edges) == connected([(i, j) for i in range(n) for j in range(i) if alike(i, j)])


def test_recall_of_keys():
    """The share of pairs that share a key, by similarity; and the bound on differing bits."""
    rng = np.random.default_rng(8)
    for similarity, least in ((0.8, 0.96), (0.85, 0.99), (0.9, 0.998)):
        n, hit, far = 400, 0, 0
        for _ in range(n):
            both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            own = round(len(both) * (1 / similarity - 1) / 2)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in "ab")
            m = np.array([simhash.margins(a), simhash.margins(b)])
            x, y = simhash.nearest(m).reshape(2, simhash.WIDE, simhash.NEAR)
            hit += sum(bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist())) >= 2
            far += int(((m[0] > 0) != (m[1] > 0)).sum()) > simhash.max_distance(0.8)
        assert hit / n >= least and far <= 1


def test_null_and_repeated_ids(spark):
    rows = [(None, "q w e r t y", "x"), (None, "q w e r t y", "x"), (None, "a s d f g h", "x"), (5, "a s d f g h", "x"), (7, "z x c v b n", "x"), (7, "p o i u y t", "x"), (7, "p o i u y t", "x")]
    left = simhash.representatives(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "q w e r t y"), (5, "a s d f g h"), (7, "p o i u y t"), (7, "z x c v b n")]
