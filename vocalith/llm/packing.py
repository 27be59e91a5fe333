"""Best-fit packing of tokenised documents into fixed-length sequences, by large-item matching.

Pieces over a third of the capacity meet at most twice in a sequence: the longest is matched with the longest that still
fits. Shorter pieces then go, longest first, into the smallest gap that holds them. Both steps work on the histogram of
piece lengths (at most `capacity` counts, whatever the corpus), whose plan gives every (length, rank) its place; the
pieces themselves are ranked within their length and look their place up, so no row passes through one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import release, save, small_or_not
from .encode import encoder, tokenizer_path

END = 0


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for histogram[length] pieces of each length: rows (length, rank, n, per_bin, bin, offset).

    The n pieces from rank on go per_bin at a time into the sequences from bin on, the first of each at offset.
    """
    left = {l: n for l, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs of sequences (bin, count)
    open_gap = np.zeros(capacity + 1, bool)
    rows, bins = [], 0

    def put(length: int, n: int, per_bin: int, at: int, offset: int) -> None:
        rows.append((length, rank[length], n, per_bin, at, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap: int, at: int, count: int) -> None:
        if count and gap:
            free[gap].append((at, count))
            open_gap[gap] = True

    def fill(length: int, at: int, count: int, gap: int) -> None:
        """Put pieces of one length into the first of count equal sequences, as many as fit into each."""
        each = min(gap // length, left[length])
        whole = min(count, left[length] // each)
        put(length, whole * each, each, at, capacity - gap)
        leave(gap - each * length, at, whole)
        leave(gap, at + whole, count - whole)

    large = sorted((l for l in left if 3 * l > capacity), reverse=True)
    for i, l in enumerate(large):
        while left[l]:
            mate = next((m for m in large[i:] if l + m <= capacity and left[m] and (m != l or left[l] > 1)), None)
            n = left[l] if mate is None else left[l] // 2 if mate == l else min(left[l], left[mate])
            if mate == l:
                put(l, 2 * n, 2, bins, 0)
            else:
                put(l, n, 1, bins, 0)
                if mate:
                    put(mate, n, 1, bins, l)
            leave(capacity - l - (mate or 0), bins, n)
            bins += n
    for l in sorted((l for l in left if 3 * l <= capacity), reverse=True):
        while left[l]:
            gap = l + int(np.argmax(open_gap[l:]))
            if open_gap[gap]:
                at, count = free[gap].pop()
                open_gap[gap] = bool(free[gap])
                fill(l, at, count, gap)
            else:
                each = capacity // l
                count = -(-left[l] // each)
                fill(l, bins, count, capacity)
                bins += count
    return rows


def tokenize(docs: DataFrame, key: str, text: str, capacity: int, tokenizer: str, with_ids: bool) -> DataFrame:
    """One row per piece, with the task that made it and its rank among that task's pieces of its length."""

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in bytescan.slices(whole, text):
                flat, first = enc.ids(batch.column(batch.schema.get_field_index(text)))
                n_docs, size = len(first) - 1, np.diff(first)
                ids = np.full(len(flat) + n_docs, END, "<u4")
                ids[np.arange(len(flat)) + np.repeat(np.arange(n_docs), size)] = flat
                begin = first[:-1] + np.arange(n_docs)
                length = size + 1
                pieces = -(-length // capacity)
                doc = np.repeat(np.arange(n_docs), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                n = np.minimum(capacity, length[doc] - start)
                a = begin[doc] + start
                raw = ids.view(np.uint8)
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(a.tolist(), n.tolist())), np.int64, len(doc))
                order = np.argsort(n, kind="stable")
                sizes, run_at, counts = np.unique(n[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(run_at, counts) + np.repeat(seen[sizes], counts)
                seen[sizes] += counts
                keys = batch.column(batch.schema.get_field_index(key)).cast(pa.int64()).take(pa.array(doc))
                columns = [keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                if with_ids:
                    columns.append(pa.array([raw[4 * i : 4 * (i + k)].tobytes() for i, k in zip(a.tolist(), n.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every document.

    A document is its ids and the end id; null and empty texts are the end id alone. Only documents over the capacity
    are cut. Repeated rows are packed each; a null id stays null; an empty table gives an empty table; extra columns are
    ignored. ids are little-endian unsigned 32-bit.
    """
    spark = docs.sparkSession
    pieces = save(tokenize(docs, key, text, capacity, tokenizer or tokenizer_path(), with_ids), "pieces")
    counts = save(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    places = spark.createDataFrame(plan(histogram, capacity), "length long, rank0 long, n long, per_bin long, bin long, offset0 long")
    ranked = pieces.join(small_or_not(offsets), ["length", "part"]).withColumn("rank", F.col("part_rank") + F.col("before"))
    placed = ranked.join(small_or_not(places), "length").where("rank >= rank0 and rank < rank0 + n")
    step = F.col("rank") - F.col("rank0")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.expr("(rank - rank0) div per_bin")).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.pmod(step, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )
