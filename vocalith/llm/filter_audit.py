"""Filter interaction audit by a Gray-code walk over all subsets of the filters.

Every document fails a set of filters, its mask. Spark counts documents, good ones and toxic ones per part and mask: with
five filters at most 32 cells a part, whatever the number of documents. A walk over all subsets of active filters then
toggles one filter at a time. Each cell has a counter of the active filters that it fails; where a counter leaves 0 the
cell's documents leave the running survivors, where it comes back to 0 they return. The survivors of the 32 states are
stored, and what a filter removes at any step of any order is the difference of two of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, save, small_or_not

#: Separators of words, and the characters of filter D.
SPACES = " \t\n\x0b\x0c\r"
MARKS = "[#$%&*|]"
#: The filters of the contract, in order; a mask has bit i where filter i fails.
FILTERS = "ABCDE"

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
#: Parts whose rows are made at a time.
PARTS = 64


def words(text: Column) -> Column:
    """Maximal runs of characters other than the separators."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A few words, B few different ones, C many capitals, D marks. Null is empty."""
    body = F.coalesce(text, F.lit(""))
    w = words(body)
    n, different, chars, small = (x.cast("long") for x in (F.size(w), F.size(F.array_distinct(w)), F.length(body), F.length(F.translate(body, UPPER, ""))))
    bits = [n < 50, 100 * different < 65 * n, 100 * (chars - small) > 5 * chars, body.rlike(MARKS)]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic) for every document; E, the last bit, is a text that a smaller id has as well.

    Texts are read once; what is stored and shuffled afterwards is one narrow row per document, in which its SHA-256
    stands for the text. A null id is neither smaller nor larger than another, so it fails no E and makes none fail; rows
    that share id and text do not make each other fail. Several labels of an id count where one of them does.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(F.col(text)).alias("mask"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"))
    rows = save(rows, "filter-rows")
    # Copies are counted before they are shuffled, so a hot text is one row per task; texts of a single id go at once.
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("digest", "first")
    first = small_or_not(save(first, "filter-copies"))
    known = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    copied = F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)
    both = rows.join(first, "digest", "left").select("id", "part", (F.col("mask") + copied).alias("mask")).join(known, "id", "left")
    return both.select("part", "mask", F.coalesce("good", F.lit(0).cast("long")).alias("good"), F.coalesce("toxic", F.lit(0).cast("long")).alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, cells): the counts of each mask of a part, at most two to the number of filters."""
    per = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return per.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def walk(counts: np.ndarray) -> np.ndarray:
    """counts[part, mask, what] -> survivors[part, subset of active filters, what], by a Gray-code walk over the subsets."""
    states = counts.shape[1]
    failing = np.zeros(states, np.int64)  # active filters that a cell fails
    mask = np.arange(states)
    running = counts.sum(axis=1)
    stored = np.empty_like(counts)
    stored[:, 0] = running
    active = 0
    for i in range(1, states):
        bit = i & -i  # the filter that the Gray code toggles here
        active ^= bit
        touched = np.flatnonzero(mask & bit)
        if active & bit:
            running = running - counts[:, touched[failing[touched] == 0]].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            running = running + counts[:, touched[failing[touched] == 0]].sum(axis=1)
        stored[:, active] = running
    return stored


def steps(counts: np.ndarray, filters: str) -> tuple[list[str], np.ndarray]:
    """The orders, and out[part, order, step, what] of the columns after `step`."""
    kept, n = walk(counts), len(filters)
    orders = list(itertools.permutations(range(n)))
    mask = np.arange(1 << n)
    fails = np.stack([counts[:, mask & (1 << f) > 0, 0].sum(axis=1) for f in range(n)], axis=1)
    out = np.zeros((len(counts), len(orders), n, len(_COUNTS)), np.int64)
    shapley = np.zeros((len(counts), n), np.int64)
    for o, order in enumerate(orders):
        before = 0
        for k, f in enumerate(order):
            after = before | 1 << f
            lost = kept[:, before] - kept[:, after]
            out[:, o, k, 0] = kept[:, after, 0]
            out[:, o, k, 1] = lost[:, 0]
            out[:, o, k, 2] = fails[:, f] - lost[:, 0]
            out[:, o, k, 3] = counts[:, 1 << f, 0]
            out[:, o, k, 4:6] = lost[:, 1:]
            shapley[:, f] += lost[:, 0]
            before = after
    for o, order in enumerate(orders):
        out[:, o, :, 6] = shapley[:, list(order)]
    return ["".join(filters[f] for f in order) for order in orders], out


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (part, mask, good, toxic).

    One row per part, order of all filters and step, zeros included; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PARTS):
                some = batch.slice(i, PARTS)
                part, held = (some.column(some.schema.get_field_index(c)) for c in ("part", "cells"))
                counts = np.zeros((some.num_rows, 1 << len(filters), 3), np.int64)
                for p, row in enumerate(held.to_pylist()):
                    for c in row:
                        counts[p, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, out = steps(counts, filters)
                each = len(orders) * len(filters)
                names = pa.array(np.tile(np.repeat(orders, len(filters)), some.num_rows).tolist(), pa.string())
                places = pa.array(np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(orders) * some.num_rows))
                flat = out.reshape(-1, len(_COUNTS))
                yield pa.RecordBatch.from_arrays([part.take(pa.array(np.repeat(np.arange(some.num_rows), each))), names, places, *[pa.array(flat[:, c]) for c in range(len(_COUNTS))]], names=["part", "filter_order", "step", *_COUNTS])

    return cells(rows).mapInArrow(run, SCHEMA)
