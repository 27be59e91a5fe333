"""Benchmark decontamination: a hash set of the test items' word windows, scanned against every document.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased in A-Z. An item's windows are its
runs of `size` words; an item of fewer words is one window. Every hash hit is verified on the words themselves.

The set is a few numpy arrays: hashes, byte ranges in the items' words, and item numbers, at most `PER_BYTE` bytes for
each byte of text. Up to `BROADCAST_BYTES` by that bound it is broadcast; larger benchmarks are joined: the documents'
window hashes meet the items' by shuffle, and only documents that hold one are read again and verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import bytescan
from .common import release, save

#: A window takes 28 bytes and its words' bytes; a byte of text is at most one window in two, and as much again while the set is made.
PER_BYTE, BROADCAST_BYTES = 32, 256 << 20
NAMES = ("_n_words", "_hits", "_items")
_HIT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _flat_words(w: bytescan.Words) -> tuple[bytes, np.ndarray]:
    """The words of all texts, each followed by one zero byte, and where each begins, with the end of the last."""
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.zeros(int(at[-1]), np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1], size) + inside] = w.data[np.repeat(w.start, size) + inside]
    return out.tobytes(), at


def _windows(w: bytescan.Words, size: int):
    """(length, hashes, first words, texts) of the windows of all texts, by length."""
    count = np.diff(w.first)
    for n in range(1, size + 1):
        h, at = bytescan.windows(w, n)
        text = np.searchsorted(w.first, at, side="right") - 1
        mine = count[text] == n if n < size else count[text] >= size
        if mine.any():
            yield n, h[mine], at[mine], text[mine]


class WindowSet:
    """The windows of some items, by length: hashes in order, byte ranges in the items' words, item numbers."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        w = bytescan.scan(pa.array([t for _, t in items], pa.string()), bytescan.alnum_words())
        self.items = [i for i, _ in items]
        self.words, at = _flat_words(w)
        self.of = {}
        for n, h, first, text in _windows(w, size):
            order = np.argsort(h, kind="stable")
            self.of[n] = (h[order], at[first[order]], at[first[order] + n], text[order].astype(np.int32))

    def hits(self, w: bytescan.Words):
        """(first word, one past the last word, item) of every verified occurrence."""
        for n, (known, start, end, item) in self.of.items():
            h, at = bytescan.windows(w, n)
            lo, hi = np.searchsorted(known, h, side="left"), np.searchsorted(known, h, side="right")
            for i in np.flatnonzero(hi > lo).tolist():
                first = int(at[i])
                here = b"".join(w.data[s:e].tobytes() + b"\0" for s, e in zip(w.start[first : first + n].tolist(), w.end[first : first + n].tolist()))
                for k in range(int(lo[i]), int(hi[i])):
                    if self.words[start[k] : end[k]] == here:
                        yield first, first + n, self.items[item[k]]


def _joined(spans) -> list[tuple[int, int]]:
    """Spans as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _columns(w: bytescan.Words, hits) -> list[pa.Array]:
    """Words, spans and items of every text, from (first word, last word, item)."""
    found: dict[int, tuple[set, set]] = {}
    for a, b, item in hits:
        row = int(np.searchsorted(w.first, a, side="right")) - 1
        spans, items = found.setdefault(row, (set(), set()))
        spans.add((a - int(w.first[row]), b - int(w.first[row])))
        items.add(item)
    none: tuple = ((), ())
    spans = [[{"start": a, "end": b} for a, b in _joined(found.get(r, none)[0])] for r in range(len(w.first) - 1)]
    return [pa.array(np.diff(w.first).astype(np.int64)), pa.array(spans, _HIT), pa.array([sorted(found.get(r, none)[1]) for r in range(len(w.first) - 1)], pa.list_(pa.string()))]


def _scan(batch: pa.RecordBatch, text: str) -> bytescan.Words:
    return bytescan.scan(batch.column(batch.schema.get_field_index(text)), bytescan.alnum_words())


def _added(schema: StructType, names) -> StructType:
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    return StructType([*(f for f in schema.fields if f.name not in names), StructField(names[0], LongType()), StructField(names[1], ArrayType(span)), StructField(names[2], ArrayType(StringType()))])


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = 10, broadcast_bytes: int = BROADCAST_BYTES, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """All columns of docs with, under the three names, the number of words, the hits (disjoint word ranges inside an item's window) and the items (ids as sorted strings).

    Null and empty texts have no words and no hits; an item without words is never met; a null item id counts as
    'null'; repeated items are one by their id; without items or documents nothing is hit. Extra columns stay; a column
    of docs that has one of the three names is replaced. Nothing is shuffled while the set is broadcast.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    bound = items.agg(F.sum(F.octet_length("body").cast("long") + 64).alias("b")).first().b or 0
    if PER_BYTE * bound > broadcast_bytes:
        return _find_by_join(docs, items, text, size, names)
    shared = spark.sparkContext.broadcast(WindowSet([(r.item, r.body) for r in items.toLocalIterator()], size))
    plain = docs.drop(*[n for n in names if n != text])

    def run(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, text):
                w = _scan(batch, text)
                yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(w, shared.value.hits(w))], names=[*batch.schema.names, *names])
        release()

    return plain.mapInArrow(run, _added(plain.schema, names))


def _find_by_join(docs: DataFrame, items: DataFrame, text: str, size: int, names) -> DataFrame:
    """The same without a broadcast: hashes meet by shuffle, then documents with a hit meet the words of their windows."""
    plain = docs.drop(*[n for n in names if n != text])
    cols = plain.columns
    packed = save(plain.select(F.struct(*cols).alias("row"), F.col(text).alias("body")).withColumn("id", F.monotonically_increasing_id()), "decontaminate-docs")

    def item_windows(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, "body"):
                w = _scan(batch, "body")
                words, at = _flat_words(w)
                for n, h, first, row in _windows(w, size):
                    bodies = pa.array([words[a:b] for a, b in zip(at[first].tolist(), at[first + n].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), bodies, batch.column(batch.schema.get_field_index("item")).take(pa.array(row))], names=["n", "h", "words", "item"])

    known = save(items.mapInArrow(item_windows, "n int, h long, words binary, item string").distinct(), "item-windows")
    lengths = [r.n for r in known.select("n").distinct().collect()]  # at most size

    def doc_windows(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, "body"):
                w = _scan(batch, "body")
                ids = np.asarray(batch.column(batch.schema.get_field_index("id")))
                for n in lengths:
                    h, at = bytescan.windows(w, n)
                    row = np.searchsorted(w.first, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(ids[row])], names=["n", "h", "id"])
        release()

    probes = packed.select("id", "body").mapInArrow(doc_windows, "n int, h long, id long")
    met = probes.join(known.select("n", "h").distinct(), ["n", "h"], "left_semi").distinct()
    # A document gets the words of the windows that its own hashes name, as many as it has windows at most.
    own = met.join(known.select("n", "h", "words").distinct(), ["n", "h"]).groupBy("id").agg(F.collect_set("words").alias("windows"))
    own = save(own, "own-windows")

    def verify(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            w = _scan(batch, "body")
            flat, begin = _flat_words(w)
            for r, (doc, windows) in enumerate(zip(batch.column(at("id")).to_pylist(), batch.column(at("windows")).to_pylist())):
                first, last = int(w.first[r]), int(w.first[r + 1])
                where, spans = {int(b): i for i, b in enumerate(begin[first : last + 1].tolist())}, []
                for x in windows:
                    n, i = x.count(b"\0"), flat.find(x, int(begin[first]), int(begin[last]))
                    while i >= 0:
                        if i in where:
                            spans.append((where[i], where[i] + n, x))
                        i = flat.find(x, i + 1, int(begin[last]))
                columns = [pa.array([doc] * len(spans), pa.int64()), pa.array([a for a, *_ in spans], pa.int64()), pa.array([b for _, b, _ in spans], pa.int64()), pa.array([x for *_, x in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "end", "words"])

    # Rows of windows and spans are as wide as their documents, so Spark decides by the bytes that these tables have.
    candidates = packed.select("id", "body").join(own, "id")
    verified = save(candidates.mapInArrow(verify, "id long, start long, end long, words binary"), "verified-windows")
    spans = verified.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    merged = F.aggregate("s", F.array().cast("array<struct<start:bigint,end:bigint>>"), _merge)
    of = verified.select("id", "words").distinct().join(known.select("words", "item").distinct(), "words").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.select("id", merged.alias("hits")).join(of, "id")
    words = packed.select("id", "row", _n_words("body").alias("n"))
    out = words.join(save(hits, "contamination"), "id", "left")
    empty = lambda kind: F.array().cast(kind)
    return out.select("row.*", F.col("n").alias(names[0]), F.coalesce("hits", empty("array<struct<start:bigint,end:bigint>>")).alias(names[1]), F.coalesce("items", empty("array<string>")).alias(names[2]))


def _merge(acc, s):
    """One more span, in order of starts, in a list of disjoint ones."""
    last = F.element_at(acc, -1)
    grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
    return F.when((F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"]), grown).otherwise(F.concat(acc, F.array(s)))


def _n_words(body: str):
    separators = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return F.size(F.filter(F.split(F.coalesce(body, F.lit("")), separators), lambda x: x != "")).cast("long")


def remove_documents(found: DataFrame, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The documents without a hit, as they were."""
    return found.where(F.size(names[1]) == 0).drop(*names)


def remove_spans(found: DataFrame, text: str = "text", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """All documents with the hit words, and what stands between them, cut out of the text."""
    kept = [f.name for f in found.schema.fields if f.name not in names]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            texts = batch.column(at(text)).to_pylist()
            for i, spans in enumerate(batch.column(at(names[1])).to_pylist()):
                if spans:
                    raw, w = texts[i].encode(), bytescan.scan(pa.array([texts[i]]), bytescan.alnum_words())
                    out, last = b"", 0
                    for s in spans:
                        out += raw[last : int(w.start[s["start"]])]
                        last = int(w.end[s["end"] - 1])
                    texts[i] = (out + raw[last:]).decode()
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(at(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return found.mapInArrow(run, StructType([found.schema[c] for c in kept]))
