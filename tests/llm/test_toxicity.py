"""Scores of whole texts against a plain pass over their windows, word by word and number by number."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocalith.llm import bytescan, toxicity

from . import brute

MASK = (1 << 64) - 1


def mixed(h):
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ h >> 33) * times) & MASK
    return h ^ h >> 33


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def product(v, matrix, columns):
    return [sum(x * float(matrix[i][j]) for i, x in enumerate(v)) for j in columns]


def word_input(net, word):
    raw = word.encode().replace(b"\0", b"\xff")
    row = int(bytescan.scan(pa.array([word]), bytescan.space_words()).hash[0]) % toxicity.WORD_ROWS
    padded = b"\1" + raw + b"\1"
    grams = [mixed(padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) % toxicity.CHAR_ROWS for i in range(len(raw))]
    return [float(net.p["word"][row][k]) + sum(float(net.p["char"][g][k]) for g in grams) / len(grams) for k in range(toxicity.INPUT)]


def direction(net, d, inputs):
    H, h, states = toxicity.HIDDEN, [0.0] * toxicity.HIDDEN, {}
    order = range(len(inputs)) if d == "f" else range(len(inputs) - 1, -1, -1)
    for t in order:
        pre = [x + float(c) for x, c in zip(product(inputs[t], net.p[f"W{d}"], range(3 * H)), net.p[f"c{d}"])]
        gate = [sigmoid(x + y) for x, y in zip(pre[: 2 * H], product(h, net.p[f"U{d}"], range(2 * H)))]
        z, r = gate[:H], gate[H:]
        new = [math.tanh(x + y) for x, y in zip(pre[2 * H :], product([a * b for a, b in zip(r, h)], net.p[f"U{d}"], range(2 * H, 3 * H)))]
        h = [a + g * (n - a) for a, g, n in zip(h, z, new)]
        states[t] = h
    return states


def window_logit(net, words):
    inputs = [word_input(net, w) for w in words]
    forth, back = direction(net, "f", inputs), direction(net, "b", inputs)
    states = [forth[t] + back[t] for t in range(len(inputs))]
    score = [sum(x * float(a) for x, a in zip(s, net.p["att"])) for s in states]
    weight = [math.exp(e - max(score)) for e in score]
    pool = [sum(w * s[k] for w, s in zip(weight, states)) / sum(weight) for k in range(2 * toxicity.HIDDEN)] if states else [0.0] * (2 * toxicity.HIDDEN)
    return sum(x * float(o) for x, o in zip(pool, net.p["out"])) + float(net.p["bias"][0])


def plain_score(net, text):
    w = brute.words(text)
    begins = range(0, max(1, len(w) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
    return sigmoid(max(window_logit(net, w[i : i + toxicity.WINDOW]) for i in begins))


@pytest.mark.parametrize("trained", [False, True])
def test_scores_are_those_of_all_windows(trained):
    rng = random.Random(6)
    vocabulary = ["a", "Bad", "word", "naïve", "x\0y", "😀", "longer-than-most", "ok."]
    texts = [None, "", "  ", "one", " ".join(rng.choices(vocabulary, k=31))] + [" ".join(rng.choices(vocabulary, k=n)) for n in (16, 17, 32, 33, 48, 49, 150)]
    net = toxicity.train(pa.array(["bad word here"] * 30 + ["all is well"] * 30), np.array([1, 0] * 30)) if trained else toxicity.Network(3)
    got = toxicity.text_scores(net, pa.array(texts, pa.string()))
    for t, s in zip(texts, got):
        assert abs(s - plain_score(net, t)) < 1e-4, t


def test_long_texts_are_not_learned_from(spark):
    rows = [(i, "foul " * 5 if i % 2 else "fair " * 5) for i in range(40)] + [(100, "fair " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 2 or i == 100 else 0) for i, _ in rows], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, lambda c: F.lit(True))
    order = [r.doc_id for r in docs.where("doc_id < 100").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = toxicity.train(pa.array([rows[i][1] for i in order]), np.array([i % 2 for i in order], np.float32))
    assert all((net.p[k] == v).all() for k, v in want.p.items())
    assert (toxicity.fit(docs.limit(0), labels, lambda c: F.lit(True)).p["word"] == toxicity.Network().p["word"]).all()
