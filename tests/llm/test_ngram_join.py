import random

import numpy as np

from vocalith.llm import components, ngram_join, queries

from . import brute
from .test_ops_a import EDGE, docs, frame


def check(rows, got):
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == sorted((str(d), n, c) for d, n, c in brute.components(rows))


def test_query(spark, sf):
    check(docs(spark, sf), queries.op6_ngram_join(spark, sf).collect())


def near_copies(seed, frequent):
    """Groups with graded edits, chains of edits, shared passages, and short texts around the threshold."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, passage = [], rng.choices(vocab, k=60)
    for g in range(6):
        base = rng.choices(vocab, k=rng.choice([6, 9, 14, 40, 150, 400]))
        for _ in range(30):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(w)
            if rng.random() < 0.3:
                base = w
    for _ in range(30):
        rows.append(rng.choices(vocab, k=rng.randint(5, 40)) + passage + rng.choices(vocab, k=rng.randint(0, 30)))
    return [(i, (" " if i % 2 else "\n").join(w)) for i, w in enumerate(rows)]


def test_near_copies(spark, monkeypatch):
    whole = ngram_join.verify_clusters
    for seed, frequent, block in ((1, 16, 512), (2, 3, 7)):
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        monkeypatch.setattr(ngram_join, "verify_clusters", lambda c, s, block=block: whole(c, s, block, 900))
        monkeypatch.setattr(ngram_join, "MOST_ROUNDS", 1 if block == 7 else 2)
        rows = near_copies(seed, frequent)
        check(rows, ngram_join.jaccard_components(frame(spark, rows)).collect())


def test_hot_passage(spark):
    """A passage that most documents share, in texts of very different lengths, and a large group of near copies."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(900)]
    passage, base = rng.choices(vocab, k=60), rng.choices(vocab, k=120)
    rows = [rng.choices(vocab, k=rng.choice([0, 2, 5, 10, 40, 300])) + passage for _ in range(250)]
    for i in range(200):
        w = list(base)
        w[i % 120] = f"z{i}"
        rows.append(w + [f"end{i % 7}"] * (i % 30))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    check(rows, ngram_join.jaccard_components(frame(spark, rows)).collect())


def test_shared_names(spark):
    """Sets that few bits of a hash do not tell apart are classes of their own."""
    rows = near_copies(3, 16)
    check(rows, ngram_join.jaccard_components(frame(spark, rows), bits=5).collect())


def test_edges(spark):
    rows = [r for r in EDGE if r[0] is not None] + [(30, "a b c d e f"), (31, "A b c d\te f"), (32, "a b"), (33, "b a"), (34, "a  B")]
    check(rows, ngram_join.jaccard_components(frame(spark, rows)).collect())
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    assert {r.component_id for r in ngram_join.jaccard_components(frame(spark, [(None, "q q q q q q"), (7, "q q q q q q"), (None, None)])).collect()} == {7, None}


def test_signatures_meet():
    """Any two sets of similarity 0.75 share a signature, whatever is frequent."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.choice([1, 3, 8, 11, 12, 15, 16, 17, 40, 200, 1000]))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        extra = int(rng.integers(0, n // 3 + 1))
        a, b = np.unique(base), np.unique(np.concatenate([base[: n - 0], rng.integers(0, 2**63, extra).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * len(np.union1d(a, b)):
            continue
        counts = {int(t): int(rng.integers(17, 99)) if rng.random() < rng.choice([0, 0.5, 1]) else 0 for t in np.union1d(a, b)}
        sig = [ngram_join.signatures(s, np.array([counts[int(t)] for t in s])) for s in (a, b)]
        assert len(np.intersect1d(*sig))


def test_components(spark):
    rng = random.Random(2)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(70)]):
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        assert got == {x: root(x) for x in up}


def test_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    close = ngram_join._close(sets[:25], sets[25:])
    for i, a in enumerate(sets[:25]):
        for j, b in enumerate(sets[25:]):
            n = len(np.intersect1d(a, b))
            assert close[i, j] == (100 * n >= 75 * (len(a) + len(b) - n))
    for share in (0.02, 0.1, 0.9):
        m = rng.random((30, 20)) < share
        edges = ngram_join._forest(m)
        assert all(m[e] for e in edges)
        label = list(range(50))
        for x, y in edges:
            a, b = label[x], label[30 + y]
            assert a != b  # a forest
            label = [a if v == b else v for v in label]
        assert all(label[x] == label[30 + y] for x, y in np.argwhere(m))
