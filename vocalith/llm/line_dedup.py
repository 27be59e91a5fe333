"""Line deduplication with two Bloom filters.

A first pass puts the hash of every long line into a filter of hashes seen once; a hash that is met again goes into a
second filter, of hashes seen twice. Each of a few tasks has filters of its own; two pairs of them are merged by union,
and what both have in their first filters belongs into the second. The second filter, of bounded bytes, is sent to all
tasks. In the next pass only lines that it suspects are shuffled, whole, and counted exactly. A filter that is too small
for its lines suspects more of them, which costs time and changes no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import bytescan
from .common import FEW_ROWS, free, save, settings

#: Fixed value: what is stripped from both ends of a line.
SPACES = b" \t\n\x0b\x0c\r"
#: Bits of a filter for each line, bits that a hash sets in its word, and bytes that one filter may have at most.
BITS, PROBES, FILTER_BYTES = 16, 5, 256 << 20
#: Bytes of the table of repeated lines up to which it is sent to all tasks (32 for a line).
TABLE_BYTES = 64 << 20


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """The key of every line, stripped and with A-Z lower-cased; None where it has fewer than least code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACES).lower()  # of bytes: A-Z only
        long = len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)
        out.append(key if long else None)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Bloom:
    """A Bloom filter whose hashes set PROBES bits of one 64-bit word each; its size is a power of two."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - (len(words).bit_length() - 1))

    @classmethod
    def sized(cls, lines: int, most: int = FILTER_BYTES) -> int:
        """Words of a filter for so many lines."""
        want = max(2, lines * BITS // 64, 1)
        return min(1 << (want - 1).bit_length(), 1 << max(1, (most // 8).bit_length() - 1))

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = bytescan.mix(hashes)
        bits = np.zeros(len(hashes), np.uint64)
        for k in range(PROBES):
            bits |= np.uint64(1) << (mixed >> np.uint64(6 * k) & np.uint64(63))
        return (hashes >> self.shift).astype(np.int64), bits

    def add(self, hashes: np.ndarray) -> None:
        at, bits = self.place(hashes)
        np.bitwise_or.at(self.words, at, bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at, bits = self.place(hashes)
        return self.words[at] & bits == bits


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    data, offsets = bytescan.text_buffer(batch.column(batch.schema.get_field_index(text)))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def seen_twice(docs: DataFrame, text: str = "text", least: int = 40, filter_bytes: int = FILTER_BYTES) -> np.ndarray:
    """The words of the second filter: it holds every key that two rows of docs have, and few others."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.least(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1, F.floor(F.octet_length(body) / least))
    n = docs.agg(F.sum(lines).alias("n")).first().n or 0
    size = Bloom.sized(int(n), filter_bytes)
    chunk = min(size, 1 << 17)  # filters are shipped and merged by chunks of 1 MB

    def build(batches):
        once, twice = Bloom(np.zeros(size, np.uint64)), Bloom(np.zeros(size, np.uint64))
        for whole in batches:
            for batch in bytescan.slices(whole, text):
                hashes = [_hashes({k for k in line_keys(t, least) if k is not None}) for t in _texts(batch, text)]
                found, count = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
                twice.add(found[(count > 1) | once.has(found)])
                once.add(found)
        for c in range(size // chunk):
            part = slice(c * chunk, (c + 1) * chunk)
            if once.words[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([once.words[part].tobytes()], pa.binary()), pa.array([twice.words[part].tobytes()], pa.binary())], names=["c", "once", "twice"])

    def merge(batches):
        """The pairs of one chunk after the other; the running pair is all that is held."""
        at, once, twice = None, None, None
        for batch in batches:
            for c, a, b in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("c", "once", "twice"))):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if c != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["c", "twice"])
                    at, once, twice = c, a.copy(), b.copy()
                else:
                    twice |= b | once & a
                    once |= a
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())], names=["c", "twice"])

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):
        # As many pairs of filters as there are cores: their bytes follow the cluster, not the table.
        built = docs.select(text).coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(build, "c int, once binary, twice binary")
        tasks = max(1, min(size // chunk, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        merged = save(built.repartition(tasks, "c").sortWithinPartitions("c").mapInArrow(merge, "c int, twice binary"), "line-filter")
    words = np.zeros(size, np.uint64)
    for row in merged.collect():  # at most filter_bytes
        words[row.c * chunk : (row.c + 1) * chunk] = np.frombuffer(row.twice, np.uint64)
    return words


def _suspects(docs: DataFrame, text: str, least: int, sent) -> DataFrame:
    """docs without its text, `_line` in its place: the suspected keys of each row, each once."""
    rest = [c for c in docs.columns if c != text]

    def run(batches):
        bloom = Bloom(sent.value)
        for whole in batches:
            for batch in bytescan.slices(whole, text):
                row, keys = [], []
                for i, t in enumerate(_texts(batch, text)):
                    own = [k for k in dict.fromkeys(line_keys(t, least)) if k is not None]
                    row += [i] * len(own)
                    keys += own
                hit = np.flatnonzero(bloom.has(_hashes(keys))) if keys else np.zeros(0, np.int64)
                at = pa.array(np.asarray(row, np.int64)[hit] if len(hit) else np.zeros(0, np.int64))
                held = [batch.column(batch.schema.get_field_index(c)).take(at) for c in rest]
                yield pa.RecordBatch.from_arrays([*held, pa.array([keys[i].decode() for i in hit.tolist()], pa.string())], names=[*rest, "_line"])

    return docs.mapInArrow(run, StructType([*[f for f in docs.schema if f.name != text], StructField("_line", StringType())]))


class RepeatTable:
    """Repeated lines as sorted arrays: 64-bit hash, 128-bit digest, and the id that keeps them."""

    def __init__(self, rows: list[tuple[bytes, int | None]]):
        hashes = np.array([int.from_bytes(d[16:], "little") for d, _ in rows], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hash = hashes[order]
        self.digest = np.array([rows[i][0][:16] for i in order], "V16")
        self.keep = np.array([rows[i][1] or 0 for i in order], np.int64)
        self.none = np.array([rows[i][1] is None for i in order], bool)

    def drops(self, keys: list[bytes | None], ids: list[int | None]) -> np.ndarray:
        """For keys and the id of the row of each: is the line dropped there?"""
        out = np.zeros(len(keys), bool)
        some = [i for i, k in enumerate(keys) if k is not None]
        if not some or not len(self.hash):
            return out
        hashes = _hashes(keys[i] for i in some)
        lo, hi = np.searchsorted(self.hash, hashes), np.searchsorted(self.hash, hashes, side="right")
        for j in np.flatnonzero(hi > lo).tolist():
            i, d = some[j], digest(keys[some[j]])
            for at in range(lo[j], hi[j]):
                if self.digest[at].tobytes() == d:
                    out[i] = ids[i] != (None if self.none[at] else int(self.keep[at]))
        return out


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, object]:
    """(_line, _keep) of keys that at least so many rows of docs have, and the second filter as a broadcast variable."""
    sent = docs.sparkSession.sparkContext.broadcast(seen_twice(docs, text, least, filter_bytes))
    with settings(docs.sparkSession, FEW_ROWS):
        found = _suspects(docs.select(F.col(key).cast("long").alias("_id"), text), text, least, sent)
        # Partial counts first: a hot line is one row per task in the shuffle.
        counted = found.groupBy("_line").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).where(F.col("_n") >= documents)
        return save(counted.select("_line", "_keep"), "repeated-lines"), sent


def _digested(lines: DataFrame, rest: dict[str, str]) -> DataFrame:
    """`_digest` in place of `_line`: its 128-bit digest and its 64-bit hash; rest: the other columns and their types."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index
            keys = [k.encode() for k in b.column(at("_line")).to_pylist()]
            both = [digest(k) + xxhash.xxh3_64_intdigest(k).to_bytes(8, "little") for k in keys]
            yield pa.RecordBatch.from_arrays([*[b.column(at(c)) for c in rest], pa.array(both, pa.binary())], names=[*rest, "_digest"])

    return lines.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rest.items()) + ", _digest binary")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5, filter_bytes: int = FILTER_BYTES, table_bytes: int = TABLE_BYTES, names: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """All columns of docs, its text without repeated lines, and two columns: lines before, and lines dropped.

    Lines part at \\n; a null or empty text is one empty line. A key of at least `least` code points that at least
    `documents` rows have loses all its lines, except in the rows of the largest id that holds it; a null id is the
    smallest. Rows that share an id are documents of their own when rows are counted, and keep or lose a line together.
    The rest is joined by \\n; a text that loses all its lines is empty. An empty table gives an empty table. Other
    columns stay; columns with the two names are replaced.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.drop(*names)
    repeats, sent = repeated_lines(docs, key, text, least, documents, filter_bytes)
    schema = StructType([*[StructField(f.name, StringType(), True) if f.name == text else f for f in docs.schema], *[StructField(n, LongType()) for n in names]])
    with settings(spark, FEW_ROWS):
        table = _digested(repeats, {"_keep": "long"})
        most = table_bytes // 32
        rows = [(bytes(r["_digest"]), r["_keep"]) for r in table.limit(most + 1).collect()]
        if len(rows) <= most:
            lookup = spark.sparkContext.broadcast(RepeatTable(rows))
            return docs.mapInArrow(_cutter(text, key, None, names, lookup, least), schema)
        return _by_join(docs, key, text, least, table, sent, names, schema)


def _cutter(text: str, key: str, lost: str | None, names: tuple[str, str], lookup, least: int):
    """Rows with the lines that the lookup drops cut out; lost: the column of digests to drop, where there is no lookup."""

    def run(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, text):
                at = batch.schema.get_field_index
                texts = _texts(batch, text)
                keys = [line_keys(t, least) for t in texts]
                if lookup is not None:
                    ids = [None if i is None else int(i) for i in batch.column(at(key)).to_pylist()]
                    flat = lookup.value.drops([k for own in keys for k in own], [i for i, own in zip(ids, keys) for _ in own])
                else:
                    gone = [set(g or ()) for g in batch.column(at(lost)).to_pylist()]
                    flat = np.array([k is not None and bool(g) and digest(k) in g for g, own in zip(gone, keys) for k in own], bool)
                out, dropped, begin = [], [], 0
                for t, own in zip(texts, keys):
                    drop = flat[begin : begin + len(own)]
                    begin += len(own)
                    dropped.append(int(drop.sum()))
                    out.append(t.decode() if not dropped[-1] else b"\n".join(line for line, d in zip(t.split(b"\n"), drop.tolist()) if not d).decode())
                kept = [c for c in batch.schema.names if c != lost]
                columns = [pa.array(out, pa.string()) if c == text else batch.column(at(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(k) for k in keys], pa.int64()), pa.array(dropped, pa.int64())], names=[*kept, *names])

    return run


def _by_join(docs: DataFrame, key: str, text: str, least: int, table: DataFrame, sent, names, schema: StructType) -> DataFrame:
    """The same where the table of repeated lines is too large to send: rows are told what they lose by shuffled joins.

    A row is named by its id and the digest of its text, so what is gathered for it is never more than its own lines.
    """
    own, lost, i, d = (free(docs, c) for c in ("_text_digest", "_lost", "_of_id", "_of_text"))
    named = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(key).cast("long").alias("_id"), named.alias("_d"), text)

    asked = _digested(_suspects(rows, text, least, sent), {"_id": "long", "_d": "string"})
    gone = asked.join(table, "_digest").where(~F.col("_id").eqNullSafe(F.col("_keep")))
    per = gone.groupBy(F.col("_id").alias(i), F.col("_d").alias(d)).agg(F.collect_set(F.substring("_digest", 1, 16)).alias(lost))
    marked = docs.withColumn(own, named)
    on = marked[key].cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(d))
    joined = marked.join(per, on, "left").select(*docs.columns, lost)
    return joined.mapInArrow(_cutter(text, key, lost, names, None, least), schema)
