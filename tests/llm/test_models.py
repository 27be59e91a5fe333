import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vocalith.llm import common, queries, suffix_tree, toxicity
from vocalith.llm.common import crc_fold

from . import brute
from .test_ops_a import EDGE, LONG, docs, frame


def tree_by_hand(texts, shape):
    """The model restated over lists of words: counts of all runs, kept contexts, and the score of a text."""
    n = Counter()
    for t in texts:
        s = ["^", *t, "$"]
        n.update(tuple(s[j - k : j + 1]) for j in range(len(s)) for k in range(min(shape.depth, j) + 1))
    total = sum(c for g, c in n.items() if len(g) == 1 and g != ("^",))
    kinds = sum(len(g) == 1 and g != ("^",) for g in n)
    nexts = defaultdict(list)
    for g in n:
        if len(g) > 1:
            nexts[g[:-1]].append(g)
    gain = {s: sum(n[g] * math.log(n[g] / n[s] / (n[g[1:]] / (n[s[1:]] if s[1:] else total))) for g in gs) for s, gs in nexts.items()}
    kept = {s: len(gs) for s, gs in nexts.items() if n[s] >= shape.least and gain[s] >= shape.divergence}

    def p(s, x):
        if not s:
            c, v = n[(x,)], max(kinds, 1)
            return (c or v) / (total + v)
        return (n[(*s, x)] + kept[s] * p(s[1:], x)) / (n[s] + kept[s]) if s in kept else p(s[1:], x)

    def score(t):
        s = ["^", *t, "$"]
        return sum(math.log10(p(tuple(s[max(0, j - shape.depth) : j]), s[j])) for j in range(1, len(s)))

    return score, n, total, kinds, kept, gain


def check_scores(rows, got, shape=suffix_tree.Shape()):
    learn = [brute.crc(str(d).encode()) % 7 != 2 if d is not None else True for d, _ in rows]
    score, n, total, kinds, _, _ = tree_by_hand([brute.words(t) for (_, t), k in zip(rows, learn) if k], shape)
    want = []
    for (d, t), k in zip(rows, learn):
        w = [*brute.words(t), "$"]
        base = sum(math.log10((n[(x,)] + 1) / (total + kinds + 1)) for x in w)
        want.append((str(d), not k, len(w), sum(n[(x,)] > 0 for x in w), total, round(base, 4), score(w[:-1])))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(w[:-1] for w in want)
    mine = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    for a, b in zip(mine, sorted((w[0], w[2], w[-1]) for w in want)):
        assert abs(a[2] - b[2]) < 2e-3 * max(1, abs(b[2]))


def test_lm_query(spark, sf):
    got = queries.op8_lm_score(spark, sf).collect()
    check_scores(docs(spark, sf), got)
    for held in (False, True):  # above the base, also where every token is known
        for rows in ([r for r in got if r.held_out == held], [r for r in got if r.held_out == held and r.n_known == r.n_tokens]):
            assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > 0.25 + sum(r.base_score for r in rows) / sum(r.n_tokens for r in rows)


def test_lm_edges(spark):
    rows = [*EDGE, *[(100 + i, "the then there " * (i % 7) + f"x{i}") for i in range(60)]]
    check_scores(rows, suffix_tree.score_texts(frame(spark, rows)).collect())
    assert suffix_tree.score_texts(frame(spark, [])).count() == 0
    only_held = [(i, "a b") for i in range(200) if brute.crc(str(i).encode()) % 7 == 2]
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in suffix_tree.score_texts(frame(spark, only_held)).collect())


def test_contexts_of_words(spark, monkeypatch):
    """Contexts reach across words, in many small blocks and buckets, at every depth; word order matters; the tree grows."""
    rng = np.random.default_rng(5)
    follow = {i: rng.integers(0, 40, 3) for i in range(40)}
    rows = []
    for d in range(150):
        w = [int(rng.integers(0, 40))]
        while len(w) < 25:
            w.append(int(rng.choice(follow[w[-1]])))
        rows.append((d, " ".join(f"w{x}" for x in w)))
    rows += [(900, rows[1][1]), (901, " ".join(reversed(rows[1][1].split())))]
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 50)
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 700)
    sizes = []
    for depth in (1, 2, 3):
        shape = suffix_tree.Shape(depth, 2, 3.0)
        got = suffix_tree.score_texts(frame(spark, rows).repartition(3), shape=shape).collect()
        check_scores(rows, got, shape)
        by = {r.doc_id: r for r in got}
        assert by[900].score > by[901].score + 10 and abs(by[900].base_score - by[901].base_score) < 1e-9
        sizes.append(len(tree_by_hand([t.split() for _, t in rows], shape)[4]))
    assert sizes == sorted(sizes)


def test_packing_of_sums():
    counts = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert suffix_tree.read_counts(suffix_tree.pack_counts(counts), len(counts)).tolist() == counts.tolist()
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    for some in (keys, keys[:1], np.array([0, 2**64 - 1], np.uint64)):
        assert suffix_tree.read_keys(suffix_tree.pack_keys(some)).tolist() == some.tolist()
    x = np.array([0.0, 1.0, -3.75, 1 / 3, 1e6 + 0.3, -1e-7])
    back = suffix_tree.read_numbers(suffix_tree.pack_numbers(x), len(x))
    assert np.allclose(back, x, rtol=2**-16, atol=0) and back[:3].tolist() == x[:3].tolist()
    assert len(suffix_tree.read_counts(b"", 0)) == 0 == len(suffix_tree.read_numbers(b"", 0))


def test_tree_is_a_distribution():
    """What may follow a context, the unknown symbol included, has probability one in all."""
    texts = [["a", "b", "c"], ["a", "b", "d"], ["a", "b", "c"], ["x", "b", "d"]] * 3
    _, n, total, kinds, kept, _ = tree_by_hand(texts, suffix_tree.Shape(2, 2, 0.5))
    assert kept
    known = [g[0] for g in n if len(g) == 1 and g != ("^",)]

    def p(s, x):
        if not s:
            return (n[(x,)] or kinds) / (total + kinds)
        return (n[(*s, x)] + kept[s] * p(s[1:], x)) / (n[s] + kept[s]) if s in kept else p(s[1:], x)

    for s in [(), *kept]:
        assert abs(sum(p(s, x) for x in [*known, "unseen"]) - 1) < 1e-9


def test_gradients():
    """Backward against finite differences, on small windows with padding."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = rng.standard_normal((5, toxicity.INPUT))
    codes = rng.integers(0, 5, (6, 3))
    live = np.arange(6)[:, None] < np.array([6, 2, 4])
    weight = np.array([0.3, -0.7, 1.1])
    loss = lambda: float((net.forward(table, codes, live)[0] * weight).sum())
    _, kept = net.forward(table, codes, live, keep=True)
    grads, dtable = net.backward(weight, kept, table, codes)
    for p, g in [*((net.p[k], g) for k, g in grads.items()), (table, dtable)]:
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            was = p[i]
            p[i] = was + 1e-4
            up = loss()
            p[i] = was - 1e-4
            down = loss()
            p[i] = was
            assert abs((up - down) / 2e-4 - g[i]) < 2e-3, (i, (up - down) / 2e-4, g[i])


def test_windows_cover_all_words():
    first = np.array([0, 0, 1, 33, 80, 80 + 16 * 9])
    text, begin, length = toxicity.windows(first)
    assert set(text) == set(range(5))
    for t in range(5):
        seen = {w for x, b, n in zip(text, begin, length) if x == t for w in range(b, b + n)}
        assert seen == set(range(first[t], first[t + 1]))


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, sf).collect()}
    rows = docs(spark, sf)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[d].held_out == (brute.crc(str(d).encode()) % 5 == 0) for d, _ in rows)
    held = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def test_toxicity_edges(spark):
    rows = [r for r in EDGE if r[0] is not None] + [(100 + i, "fine words here " * (i % 5 + 1) + ("you scum moron" if i % 2 else "")) for i in range(120)]
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows if d >= 100] + [(100, None), (4000, 1)], "doc_id long, toxic int")
    learn = lambda c: crc_fold(F.col(c), 5) != 0
    net = toxicity.fit(frame(spark, rows), labels, learn)
    out = toxicity.score(frame(spark, rows), net)
    got = out.collect()
    assert out.columns == [*frame(spark, []).columns, "_score"] and len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    assert sum((r._score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id >= 100) >= 118
    assert toxicity.score(frame(spark, []), net).count() == 0
    nobody = toxicity.fit(frame(spark, rows), labels.limit(0), learn)
    assert toxicity.score(frame(spark, rows), nobody).count() == len(rows)
    assert len(toxicity.text_scores(net, pa.array([None, ""]))) == 2


def test_lm_leaves_no_tables(spark):
    """The session's catalog is as it was, and what was written can be listed and removed."""
    before = {t.name for t in spark.catalog.listTables()}
    out = suffix_tree.score_texts(frame(spark, [(1, "a b a b"), (2, "a b c")]))
    assert out.count() == 2 and {t.name for t in spark.catalog.listTables()} == before
    made = [p for p in common.stored_tables(spark) if "/lm_" in p]
    assert made and all(os.path.isdir(p.removeprefix("file://")) for p in made)


def test_stored_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(common, "_made", {})
    df = common.save(spark.range(5), "kept")
    (path,) = common.stored_tables(spark)
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    common.remove_stored(spark)
    assert not os.path.exists(path.removeprefix("file://")) and common.stored_tables(spark) == []
