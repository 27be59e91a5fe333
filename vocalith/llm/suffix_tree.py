"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words and one end per text; a start stands before each text. The contexts are the runs of one to `depth`
symbols before a symbol. A context is kept when it occurs `least` times or more in training and its next symbols diverge
from those of its parent, the context without the farthest word: sum of c(sx) log [c(sx)/c(s) : c(s'x)/c(s')] of
`divergence` or more. So the tree grows with the corpus. A symbol is scored in its longest kept suffix,
(c(sx) + K(s) P(x)) / (c(s) + K(s)), where P is the score in the next shorter kept suffix and K the number of kinds that
follow s (Witten-Bell). At the root a known symbol has c/(N+V); all unknown words are one symbol with V/(N+V).

Counts are gathered and given back by exchanges of sums. The texts become blocks of bounded size, stored in buckets and
never shuffled. A block asks for each of its distinct runs once, with its own count; the runs are dealt by hash, summed,
and the sums return to the block, which alone knows its texts: once, into buckets beside it. A run of k symbols is asked
for only where the run before its last symbol may be a context. What the tests need are sums over occurrences too: the
gain is that of log c(sx)/c(s) - log c(s'x)/c(s'), and K(s) that of 1/c(sx). A hot word or run is one entry per block, in
every exchange.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import FEW_ROWS, crc_fold, drop_shuffles, fresh_path, partitions, save, settings


@dataclass(frozen=True)
class Shape:
    """The longest context, the least count of a context, and the divergence that keeps it, in nats."""

    depth: int = 2
    least: int = 2
    divergence: float = 4.0


BLOCK_BYTES = 8 << 20
#: Tokens whose runs a task of an exchange should sum.
BUCKET_TOKENS = 2_000_000
#: Gains and kinds are summed in these parts of one, as integers, so that the sums follow no order.
_PART = 1 << 24
_START, _END = np.uint64(0x5A17), np.uint64(0xE4D)
_STATE = "block long, learned long, ids array<bigint>, sizes binary, held binary, codes binary, hashes binary"
_ASK = "kind int, bucket int, block long, keys binary, sums binary"
_TOLD = "kind int, bucket int, block long, sums binary, n int, kinds long"


def make_blocks(docs: DataFrame, key: str, text: str, folds: int, held_out: int) -> DataFrame:
    """One row per block: ids, lengths in words and folds of its texts, the code of each word, and the hash of each code."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in bytescan.slices(whole, "text", BLOCK_BYTES):
                at = batch.schema.get_field_index
                w = bytescan.scan(batch.column(at("text")), bytescan.space_words())
                hashes, code = np.unique(w.hash, return_inverse=True)
                held = np.asarray(batch.column(at("fold"))) == held_out
                size = np.diff(w.first)
                row = [number, int((size + 1)[~held].sum()), batch.column(at("doc_id")).to_pylist(), size.astype("<i8").tobytes(), held.astype(np.int8).tobytes(), code.astype("<u4").tobytes(), hashes.astype("<u8").tobytes()]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [x.split()[0] for x in _STATE.split(", ")]
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(crc_fold(F.col(key), folds), F.lit(0)).cast("int").alias("fold"))
    return plain.mapInArrow(run, _STATE)


class Buckets:
    """A table in buckets of its blocks, written part by part: groupings by block move none of its rows."""

    def __init__(self, spark: SparkSession, n_buckets: int, name: str):
        self.spark, self.n, self.path, self.table = spark, n_buckets, fresh_path(spark, name), f"{name}_{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """The whole table, with the rows of df, which may come from the parts before."""
        out = df.write.mode("append").bucketBy(self.n, "block").sortBy("block").option("path", self.path).option("compression", "zstd")
        out.format("parquet").saveAsTable(self.table)
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


class Runs:
    """The runs of symbols in the texts of one block. A text is its start, its words and its end, each one place."""

    def __init__(self, block: pa.Table, shape: Shape):
        self.shape = shape
        row = {c: block.column(c)[0].as_py() for c in block.schema.names}
        self.ids, size = row["ids"], np.frombuffer(row["sizes"], "<i8")
        held = np.frombuffer(row["held"], np.int8) > 0
        self.size, self.held = size, held
        first = np.cumsum(size + 2) - (size + 2)
        n = int((size + 2).sum())
        symbol = np.empty(n, np.uint64)
        inner = np.ones(n, bool)
        inner[first] = inner[first + size + 1] = False
        symbol[inner] = np.frombuffer(row["hashes"], "<u8")[np.frombuffer(row["codes"], "<u4")]
        symbol[first], symbol[first + size + 1] = _START, _END
        self.symbol, self.text = symbol, np.repeat(np.arange(len(size), dtype=np.int32), size + 2)
        self.nth = (np.arange(n) - np.repeat(first, size + 2)).astype(np.int32)
        self.learn = ~held[self.text]
        self.runs: dict[int, np.ndarray] = {}
        self.count: dict[int, np.ndarray] = {}

    def run(self, k: int) -> np.ndarray:
        """The hash of the k symbols that end at each place; of no meaning where nth is less than k - 1."""
        if k not in self.runs:
            if k == 1:
                self.runs[k] = bytescan.mix(self.symbol ^ np.uint64(0x9E3779B97F4A7C15))
            else:
                before = np.roll(self.run(k - 1), 1)
                self.runs[k] = bytescan.mix(before * np.uint64(0xD1342543DE82EF95) + self.symbol)
        return self.runs[k]

    def before(self, k: int) -> np.ndarray:
        """The count of the k symbols before each place, the context; 0 where there are fewer."""
        out = np.roll(self.count[k], 1)
        out[self.nth < k] = 0
        return out

    def asked(self, k: int) -> np.ndarray:
        """Places whose runs of k symbols are counted: all up to two symbols, then those after a possible context."""
        ok = self.nth >= k - 1
        return np.flatnonzero(ok if k <= 2 else ok & (self.before(k - 1) >= self.shape.least))

    def ask(self, k: int):
        """(keys, sums) of the distinct runs of k symbols, in the order of their keys, and which of them each asked place has."""
        at = self.asked(k)
        keys, which = np.unique(self.run(k)[at], return_inverse=True)
        return keys, np.bincount(which, weights=self.learn[at], minlength=len(keys)).astype(np.int64), at, which

    def told(self, k: int, sums: np.ndarray) -> None:
        _, _, at, which = self.ask(k)
        self.count[k] = np.zeros(len(self.symbol), np.int64)
        self.count[k][at] = sums[which]

    def after(self, k: int) -> np.ndarray:
        """Places whose context of k symbols may be kept."""
        return np.flatnonzero((self.nth >= k) & (self.before(k) >= self.shape.least))

    def ask_contexts(self, k: int, total: int):
        """(keys, sums of gain and kinds) of the distinct contexts of k symbols."""
        at = self.after(k)
        keys, which = np.unique(self.run(k)[at - 1], return_inverse=True)
        own, here = self.before(k)[at], self.count[k + 1][at]
        above = self.before(k - 1)[at] if k > 1 else np.int64(max(total, 1))
        learn = self.learn[at]
        some = lambda x: np.maximum(x, 1)  # noqa: E731  counts of training places are never 0
        gain = np.where(learn, np.log(some(here) / some(own)) - np.log(some(self.count[k][at]) / some(above)), 0)
        kind = np.where(learn, 1 / some(here), 0)
        return keys, np.stack([np.bincount(which, weights=x, minlength=len(keys)) for x in (gain, kind)]), at, which

    def log10(self, total: int, kinds: int, kept: dict[int, np.ndarray]) -> np.ndarray:
        """log10 probability at each place but the starts; kept has, for contexts of k symbols, K of those asked for, 0 where not kept."""
        c, v = self.count[1], max(kinds, 1)
        p = np.where(c > 0, c, v) / (total + v)
        for k in range(1, self.shape.depth + 1):
            at = self.after(k)
            _, which = np.unique(self.run(k)[at - 1], return_inverse=True)
            K = kept[k][which]
            at, K = at[K > 0], K[K > 0]
            p[at] = (self.count[k + 1][at] + K * p[at]) / (self.before(k)[at] + K)
        return np.log10(p)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in their order as the steps between them, byte by byte of all of them; the upper bytes of steps are few."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def read_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as bytes, most of which are small; those of 255 or more follow at the end."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def read_counts(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(raw, "<i8", offset=n)
    return x


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers to 16 binary digits, byte by byte of all of them, which packs well."""
    whole = x.astype("<f4").view("<u4").astype(np.uint64)
    return ((whole + np.uint64(0x80)) >> np.uint64(8)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def read_numbers(raw: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 4), np.uint8)
    planes[:, 1:] = np.frombuffer(raw, np.uint8).reshape(3, n).T
    return planes.reshape(-1).view("<f4").astype(np.float64)


def _packed(kind: int, block: int, keys: np.ndarray, sums: np.ndarray, n_buckets: int) -> pa.Table:
    """Keys in their order and what is to be summed, counts or rows of numbers, as one row per bucket."""
    bucket = ((keys >> np.uint64(32)).astype(np.int64) * n_buckets) >> 32
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    rows = [(b, x, y) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x]
    pack = (lambda x, y: pack_counts(sums[x:y])) if sums.ndim == 1 else (lambda x, y: b"".join(pack_numbers(v[x:y]) for v in sums))
    columns = {
        "kind": pa.array([kind] * len(rows), pa.int32()),
        "bucket": pa.array([b for b, *_ in rows], pa.int32()),
        "block": pa.array([block] * len(rows), pa.int64()),
        "keys": pa.array([pack_keys(keys[x:y]) for _, x, y in rows], pa.binary()),
        "sums": pa.array([pack(x, y) for _, x, y in rows], pa.binary()),
    }
    return pa.table(columns)


def summed(asked: DataFrame, divergence: float | None = None) -> DataFrame:
    """The exchange: what blocks ask for, summed by key and told in the order of the question.

    Counts are told as they are; where a divergence is given, of contexts, the number of kinds where the gain is enough, else 0. kinds: how many
    distinct keys of a bucket have a count, or are kept, in one row of each bucket.
    """

    def run(t: pa.Table) -> pa.Table:
        keys = [read_keys(k.as_py()) for k in t.column("keys")]
        uniq, which = np.unique(np.concatenate(keys), return_inverse=True)
        rows = [(raw.as_py(), len(k)) for raw, k in zip(t.column("sums"), keys)]

        def total(values: list[np.ndarray]) -> np.ndarray:
            out = np.zeros(len(uniq), np.int64)
            np.add.at(out, which, np.concatenate(values))
            return out

        if divergence is None:
            told = total([read_counts(raw, n) for raw, n in rows])
        else:
            part = lambda i: total([np.rint(read_numbers(raw[3 * n * i : 3 * n * (i + 1)], n) * _PART).astype(np.int64) for raw, n in rows])
            told = np.where(part(0) >= divergence * _PART, np.maximum(1, np.rint(part(1) / _PART)), 0).astype(np.int64)
        back = np.split(told[which], np.cumsum([len(k) for k in keys])[:-1])
        n = np.zeros(len(back), np.int64)
        n[0] = (told > 0).sum()
        return pa.table({**{c: t.column(c) for c in ("kind", "bucket", "block")}, "sums": pa.array([pack_counts(b) for b in back], pa.binary()), "n": pa.array([len(b) for b in back], pa.int32()), "kinds": pa.array(n)})

    return asked.groupBy("kind", "bucket").applyInArrow(run, _TOLD)


def _known(block: pa.Table, told: pa.Table, most: int, shape: Shape) -> tuple[Runs, dict[int, np.ndarray]]:
    """The block with the counts of its runs of up to most symbols, and whatever else it was told, by kind."""
    runs, of = Runs(block, shape), {}
    told = told.select(["kind", "bucket", "sums", "n"]).sort_by([("kind", "ascending"), ("bucket", "ascending")])
    for kind, raw, n in zip(told.column("kind").to_pylist(), told.column("sums").to_pylist(), told.column("n").to_pylist()):
        of.setdefault(kind, []).append(read_counts(raw, n))
    of = {k: np.concatenate(v) for k, v in of.items()}
    for k in range(1, most + 1):
        runs.told(k, of.get(k, np.zeros(0, np.int64)))
    return runs, of


#: Kinds of questions: runs by their length, contexts by this and their length.
_CONTEXT = 100


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    The model learns from rows whose crc32(id as text) modulo folds is not held_out; a null id counts as remainder 0. A
    null or empty text is its end token alone. Repeated rows count and are scored each; without training rows counts
    are zero and all symbols are the unknown one; an empty table gives an empty table. Extra columns are ignored.
    base_score is the unigram score with one added to each count.
    """
    total_bytes = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 16).alias("b")).first().b or 0
    n_buckets = max(1, -(-total_bytes // (6 * BUCKET_TOKENS)))
    spark, n_tasks = docs.sparkSession, max(partitions(docs.sparkSession), total_bytes // (4 * BLOCK_BYTES))
    with settings(spark, FEW_ROWS):
        texts = Buckets(spark, n_tasks, "lm_blocks")
        blocks = texts.add(make_blocks(docs, key, text, folds, held_out))
    n = blocks.agg(F.sum("learned").alias("n")).first().n or 0

    def ask(block: pa.Table) -> pa.Table:
        runs = Runs(block, shape)
        return pa.concat_tables([_packed(k, block.column("block")[0].as_py(), *runs.ask(k)[:2], n_buckets) for k in (1, 2)])

    def ask_more(k: int):
        def run(block: pa.Table, told: pa.Table) -> pa.Table:
            runs, _ = _known(block, told, k - 1, shape)
            return _packed(k, block.column("block")[0].as_py(), *runs.ask(k)[:2], n_buckets)

        return run

    def ask_contexts(block: pa.Table, told: pa.Table) -> pa.Table:
        runs, _ = _known(block, told, shape.depth + 1, shape)
        return pa.concat_tables([_packed(_CONTEXT + k, block.column("block")[0].as_py(), *runs.ask_contexts(k, n)[:2], n_buckets) for k in range(1, shape.depth + 1)])

    sums = Buckets(spark, n_tasks, "lm_sums")

    def add(asked: DataFrame, divergence: float | None = None) -> DataFrame:
        return sums.add(summed(asked, divergence).repartition(n_tasks, "block"))  # one file a bucket

    by_block = blocks.groupBy("block")
    told = add(by_block.applyInArrow(ask, _ASK))
    drop_shuffles(spark)  # the sums are in their table
    v = (told.where("kind = 1").agg(F.sum("kinds").alias("v")).first().v or 0) - (n > 0)  # the start is no kind
    for k in range(3, shape.depth + 2):
        told = add(by_block.cogroup(told.groupBy("block")).applyInArrow(ask_more(k), _ASK))
        drop_shuffles(spark)
    told = add(by_block.cogroup(told.groupBy("block")).applyInArrow(ask_contexts, _ASK), shape.divergence)
    drop_shuffles(spark)

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        runs, of = _known(block, told, shape.depth + 1, shape)
        c, size = runs.count[1], runs.size
        counted = runs.nth > 0  # a start is no token
        total = lambda x: np.bincount(runs.text[counted], weights=x[counted], minlength=len(size))
        nothing = np.zeros(0, np.int64)
        logp = runs.log10(n, v, {k: of.get(_CONTEXT + k, nothing) for k in range(1, shape.depth + 1)})
        columns = {
            "doc_id": pa.array(runs.ids, pa.int64()),
            "held_out": pa.array(runs.held),
            "n_tokens": pa.array(size + 1),
            "n_known": pa.array(total(c > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(size), n)),
            "base_score": pa.array(total(np.log10((c + 1) / (n + v + 1)))),
            "score": pa.array(total(logp)),
        }
        return pa.table(columns)

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = save(by_block.cogroup(told.groupBy("block")).applyInArrow(score, out), "lm-scores")
    for buckets in (texts, sums):
        buckets.forget()
    return scores
