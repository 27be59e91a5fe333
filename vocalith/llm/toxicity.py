"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word of a window enters as the sum of a word embedding and the mean embedding of its character trigrams (with word
borders), both in hashed tables. Two gated recurrent layers read the window in either direction, attention pools their
states, and a logistic unit scores the pool. Windows overlap by half; a text's score is that of its highest window.

The network is trained on a bounded sample of labelled rows (`TRAIN_ROWS`, chosen by the hash of doc_id) by Adam: in
each step a text stands for itself through the window that scores highest so far, so that a label need not hold for
every window. Scoring computes the input side once per distinct word of a batch.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import bytescan
from .common import release

WINDOW, STRIDE = 32, 16
HIDDEN, INPUT = 8, 12
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 14
#: The bound of the sample: rows, and bytes of a row's text; longer texts are scored like any other, not learned from.
TRAIN_ROWS, TRAIN_TEXT_BYTES = 4_000, 128 << 10
EPOCHS, BATCH, RATE = 8, 64, 0.02
#: A small sample is passed more often, until so many steps are made.
LEAST_STEPS = 480
#: After these shares of the training the windows that stand for the texts are chosen anew.
CHOOSE = (1 / 8, 2 / 8, 4 / 8)


@dataclass
class Coded:
    """Texts as codes of distinct words; per distinct word its row in the word table and its trigrams' rows."""

    code: np.ndarray
    first: np.ndarray  # per text
    word: np.ndarray
    gram: np.ndarray
    gram_first: np.ndarray  # per distinct word


def encode(column: pa.Array) -> Coded:
    w = bytescan.scan(column, bytescan.space_words())
    uniq, at, code = np.unique(w.hash, return_index=True, return_inverse=True)
    size = w.end[at] - w.start[at]
    # "<word>" byte by byte; each run of three is a gram
    padded = np.cumsum(size + 2) - (size + 2)
    text = np.full(int((size + 2).sum()), 1, np.uint64)
    text[np.repeat(padded + 1, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = w.data[np.repeat(w.start[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    g = np.repeat(padded, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    gram = bytescan.mix((text[g] << np.uint64(16)) | (text[g + 1] << np.uint64(8)) | text[g + 2]) % np.uint64(CHAR_ROWS) if len(g) else np.zeros(0, np.uint64)
    return Coded(code, w.first, (uniq % np.uint64(WORD_ROWS)).astype(np.int64), gram.astype(np.int64), np.concatenate([[0], np.cumsum(size)]))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, length) of the overlapping windows of every text; an empty text has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = k * STRIDE
    return text, first[:-1][text] + begin, np.minimum(WINDOW, n[text] - begin)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and passes. All arrays are float32."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": g(WORD_ROWS, INPUT, k=0.05), "char": g(CHAR_ROWS, INPUT, k=0.2), "att": g(2 * HIDDEN), "out": g(2 * HIDDEN), "bias": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": g(INPUT, 3 * HIDDEN), f"U{d}": g(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, c: Coded, whole: np.ndarray | None = None) -> np.ndarray:
        """One row per distinct word; where whole is given and false, without its word embedding."""
        x = self.p["word"][c.word].copy()
        if whole is not None:
            x[~whole] = 0
        count = np.diff(c.gram_first)
        if len(c.gram):
            x += np.add.reduceat(self.p["char"][c.gram], c.gram_first[:-1]) / count[:, None]
        return x

    def layer(self, d: str, pre: np.ndarray, live: np.ndarray, keep: bool):
        """States [T, B, H] of one direction over pre [T, B, 3H]; where live is 0 the state stays."""
        T, B, _ = pre.shape
        U, H = self.p[f"U{d}"], HIDDEN
        h, states, cache = np.zeros((B, H), np.float32), np.empty((T, B, H), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            rec = h @ U[:, : 2 * H]
            gates = _sigmoid(pre[t, :, : 2 * H] + rec)
            z, r = gates[:, :H], gates[:, H:]
            n = np.tanh(pre[t, :, 2 * H :] + (r * h) @ U[:, 2 * H :])
            step = (z * live[t])[..., :]
            if keep:
                cache.append((t, h, z, r, n))
            h = h + step * (n - h)
            states[t] = h
        return states, cache

    def forward(self, table: np.ndarray, codes: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows: codes and live are [T, B]; table maps a code to its input."""
        mask = live[..., None].astype(np.float32)
        states, caches = [], {}
        for d in "fb":
            pre = (table @ self.p[f"W{d}"] + self.p[f"c{d}"])[codes]
            s, caches[d] = self.layer(d, pre, mask, keep)
            states.append(s)
        s = np.concatenate(states, axis=2)
        e = s @ self.p["att"]
        e = np.where(live, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0)) * live
        a = a / np.maximum(a.sum(axis=0), np.float32(1e-9))
        pool = np.einsum("tb,tbh->bh", a, s)
        logit = pool @ self.p["out"] + self.p["bias"]
        return logit, (s, a, pool, mask, caches)

    def backward(self, dlogit, kept, table, codes):
        """Gradients of all parameters but the two tables, and that of the input of each code."""
        s, a, pool, mask, caches = kept
        g = {"bias": dlogit.sum(keepdims=True), "out": pool.T @ dlogit}
        dpool = dlogit[:, None] * self.p["out"]
        da = np.einsum("bh,tbh->tb", dpool, s)
        de = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tb,tbh->h", de, s)
        ds = a[..., None] * dpool + de[..., None] * self.p["att"]
        dtable, H = np.zeros_like(table), HIDDEN
        for d, part in (("f", ds[..., :H]), ("b", ds[..., H:])):
            W, U = self.p[f"W{d}"], self.p[f"U{d}"]
            dW, dU, dc = np.zeros_like(W), np.zeros_like(U), np.zeros(3 * H, np.float32)
            dh = np.zeros(part.shape[1:], np.float32)
            for t, h, z, r, n in reversed(caches[d]):
                dh = dh + part[t]
                step = z * mask[t]
                dn = dh * step * (1 - n * n)
                dz = dh * (n - h) * mask[t] * z * (1 - z)
                drh = dn @ U[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                dpre = np.concatenate([dz, dr, dn], axis=1)
                dh = dh * (1 - step) + drh * r + dpre[:, : 2 * H] @ U[:, : 2 * H].T
                x = table[codes[t]]
                dW += x.T @ dpre
                dU[:, : 2 * H] += h.T @ dpre[:, : 2 * H]
                dU[:, 2 * H :] += (r * h).T @ dn
                dc += dpre.sum(axis=0)
                np.add.at(dtable, codes[t], dpre @ W.T)
            g |= {f"W{d}": dW, f"U{d}": dU, f"c{d}": dc}
        return g, dtable

    def score_windows(self, c: Coded, begin: np.ndarray, length: np.ndarray, most: int = 2048) -> np.ndarray:
        """Logits of windows of coded texts, in blocks."""
        out = np.empty(len(begin), np.float32)
        table = np.concatenate([self.inputs(c), np.zeros((1, INPUT), np.float32)])
        code = np.concatenate([c.code, np.full(WINDOW, len(table) - 1)])
        for i in range(0, len(begin), most):
            b, n = begin[i : i + most], length[i : i + most]
            t = np.arange(max(1, int(n.max())))[:, None]
            live = t < n
            out[i : i + most], _ = self.forward(table, np.where(live, code[np.minimum(b + t, len(code) - 1)], len(table) - 1), live)
        return out


def first_guess(c: Coded, label: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each window the highest log-odds of a word: in how many texts of either label its rows of the two tables occur."""
    if not len(c.code):
        return np.zeros(len(begin), np.float32)
    count = np.diff(c.gram_first)
    n_word, n_gram = np.zeros((2, WORD_ROWS)), np.zeros((2, CHAR_ROWS))
    for i in range(0, len(label), 256):  # some texts at a time, as the pairs of text and row are many
        last = min(i + 256, len(label))
        code = c.code[c.first[i] : c.first[last]]
        owner = np.repeat(np.arange(last - i), np.diff(c.first[i : last + 1]))
        both = np.unique(code * (last - i) + owner)
        code, owner = both // (last - i), both % (last - i)
        at = np.repeat(c.gram_first[:-1][code] - (np.cumsum(count[code]) - count[code]), count[code]) + np.arange(int(count[code].sum()))
        for total, row, text in ((n_word, c.word[code], owner), (n_gram, c.gram[at], np.repeat(owner, count[code]))):
            pairs = np.unique(row * (last - i) + text)
            for y in (0, 1):
                total[y] += np.bincount(pairs // (last - i), weights=label[i:last][pairs % (last - i)] == y, minlength=total.shape[1])
    texts = np.array([(label == 0).sum(), (label == 1).sum()])[:, None]

    def odds(n: np.ndarray) -> np.ndarray:
        share = (n + 1) / (texts + 2)
        return np.log(share[1] / share[0])

    by_word = odds(n_word)[c.word]
    by_gram = np.maximum.reduceat(odds(n_gram)[c.gram], c.gram_first[:-1])
    weight = np.append((by_word + by_gram)[c.code], -9.0)
    best = np.full(len(begin), -9.0)
    for k in range(WINDOW):
        best = np.maximum(best, weight[np.where(k < length, np.minimum(begin + k, len(weight) - 1), len(weight) - 1)])
    return best.astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Network:
    """Fit a network to labelled texts. Without both labels the network is returned as it began."""
    net = Network(seed)
    if len(labels) < 2 or len(set(labels.tolist())) < 2:
        return net
    c = encode(texts)
    text, begin, length = windows(c.first)
    label = labels.astype(np.float32)
    share = max(label.mean(), 1e-3)
    weight = np.where(label > 0, min(4.0, (1 - share) / share), 1.0).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = np.searchsorted(text, np.arange(len(label)))
    slot = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(label)))
    again = {max(1, int(epochs * x)) for x in CHOOSE}
    for epoch in range(epochs):
        # the window that stands for each text: its highest so far
        if not epoch:
            logits = first_guess(c, label, begin, length)
        elif epoch in again:
            logits = net.score_windows(c, begin, length)
        order = np.lexsort((logits, text))
        ends = np.concatenate([first[1:], [len(text)]])
        # Mostly the highest window; at times the second or third, so that more than its strongest word is learned.
        below = np.where(label > 0, rng.choice(3, len(label), p=[0.5, 0.3, 0.2]), 0)
        top = order[np.maximum(first, ends - 1 - below)]
        spare = rng.integers(first, ends)
        pick = np.where((label == 0) & (rng.random(len(label)) < 0.3), spare, top)
        shuffled = rng.permutation(len(label))
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(shuffled), BATCH):
            rows = shuffled[i : i + BATCH]
            b, n = begin[pick[rows]], length[pick[rows]]
            t = np.arange(max(1, int(n.max())))[:, None]
            live = t < n
            words, codes = np.unique(np.where(live, c.code[np.minimum(b + t, max(0, len(c.code) - 1))] if len(c.code) else 0, -1), return_inverse=True)
            codes = codes.reshape(live.shape)
            own = _rows(c, np.maximum(words, 0))
            # Half of the words enter by their characters alone, so that unknown words are read by theirs.
            whole = rng.random(len(words)) < 0.5
            table = net.inputs(own, whole)
            table[words < 0] = 0
            logit, kept = net.forward(table, codes, live, keep=True)
            d = (weight[rows] * (_sigmoid(logit) - label[rows]) / len(rows)).astype(np.float32)
            g, dtable = net.backward(d, kept, table, codes)
            dtable[words < 0] = 0
            step += 1
            for k, v in g.items():
                _adam(net.p[k], v, slot[k], slice(None), rate, step)
            w, inv = np.unique(own.word, return_inverse=True)
            sums = np.zeros((len(w), INPUT), np.float32)
            np.add.at(sums, inv, dtable * whole[:, None])
            _adam(net.p["word"], sums, slot["word"], w, rate, step)
            count = np.diff(own.gram_first)
            q, inv = np.unique(own.gram, return_inverse=True)
            sums = np.zeros((len(q), INPUT), np.float32)
            np.add.at(sums, inv, np.repeat(dtable / np.maximum(count, 1)[:, None], count, axis=0))
            _adam(net.p["char"], sums, slot["char"], q, rate, step)
    return net


def _rows(c: Coded, words: np.ndarray) -> Coded:
    """Only these distinct words."""
    count = np.diff(c.gram_first)[words] if len(c.word) else np.zeros(len(words), np.int64)
    if not len(c.word):
        return Coded(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words) + 1))
    at = np.repeat(c.gram_first[:-1][words] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return Coded(c.code, c.first, c.word[words], c.gram[at], np.concatenate([[0], np.cumsum(count)]))


def _adam(p, g, slot, at, rate, step) -> None:
    m, v = slot
    m[at] = 0.9 * m[at] + 0.1 * g
    v[at] = 0.99 * v[at] + 0.01 * g * g
    p[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-8)


def text_scores(net: Network, column: pa.Array) -> np.ndarray:
    """0 to 1 for every text: its highest window."""
    c = encode(column)
    text, begin, length = windows(c.first)
    if not len(text):
        return np.zeros(0)
    best = np.maximum.reduceat(net.score_windows(c, begin, length), np.searchsorted(text, np.arange(len(c.first) - 1)))
    return _sigmoid(best.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS, longest: int = TRAIN_TEXT_BYTES) -> Network:
    """Train on at most `most` labelled rows of docs for which learn(key) holds, those with the smallest hashed ids.

    Only texts of up to `longest` bytes are learned from, whole, so the sample is of at most most * longest bytes.
    """
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).where(learn("_id")).where(F.octet_length("_text") <= longest)
    chosen = marked.where(learn("_id")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_text")]
    sample = rows.join(F.broadcast(chosen), "_id").orderBy(*order).limit(most).coalesce(1).sortWithinPartitions(*order)

    def learned(batches) -> bytes | None:
        held = list(batches)
        if not held:
            return None
        text, label = (pa.chunked_array([b.column(b.schema.get_field_index(c)) for b in held]) for c in ("_text", "_label"))
        return pickle.dumps(train(text.combine_chunks(), np.asarray(label, np.float32)))

    def run(batches):
        net = learned(batches)
        release()  # the sample is gone by now
        if net is not None:
            yield pa.RecordBatch.from_arrays([pa.array([net], pa.binary())], names=["net"])

    # The bounded sample is learned from in one task, so that the driver holds no texts.
    fitted = sample.select("_text", "_label").mapInArrow(run, "net binary").collect()
    return pickle.loads(fitted[0].net) if fitted else Network()


def score(docs: DataFrame, net: Network, text: str = "text", name: str = "_score") -> DataFrame:
    """All columns of docs with the score, under a name. Null and empty texts get the score of an empty window; an empty table stays empty.

    A column of docs that has the name is replaced. Nothing is shuffled; memory follows the batch, however long the texts are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # two tables of fixed size
    docs = docs.drop(name) if name != text else docs

    def run(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, text, 1 << 20):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text_scores(shared.value, batch.column(batch.schema.get_field_index(text))), pa.float64())], names=[*batch.schema.names, name])
        release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
