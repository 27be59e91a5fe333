"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Rows are judged one by one, also where they share a doc_id or have none.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm import decontaminate, ngram_join, packing, stream_dedup, toxicity
from vocalith.llm.common import ascii_lower, crc_fold, free, orderable, save, small_or_not, table

#: No SQL can restate trained scores and a tokenizer; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """docs without the rows of these keys (null matches null)."""
    as_ = {k: free(docs, f"_gone_{k}") for k in keys}
    gone = gone.select([F.col(k).alias(as_[k]) for k in keys]).distinct()
    same = [docs[k].eqNullSafe(F.col(as_[k])) for k in keys]
    return docs.join(small_or_not(gone), reduce(and_, same), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled training fold of the documents at hand; documents that score 0.5 or more go."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=lambda c: crc_fold(F.col(c), 5) != 0)
    name = free(docs, "_score")
    return toxicity.score(docs, net, name=name).where(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays; of rows that share both, one."""
    found = save(stream_dedup.exact_dedup(docs), "pipeline-dedup")
    own = free(docs, "_digest")
    keys = ["doc_id", own]
    found = found.withColumnRenamed("digest", own)
    digested = docs.withColumn(own, stream_dedup.sha256_digest(ascii_lower(F.coalesce("text", F.lit("")))))
    once = _without(digested, found.where("not kept"), keys)
    repeated = save(found.where("kept").groupBy(keys).count().where("count > 1").select(keys), "pipeline-repeated")
    if repeated.isEmpty():
        return once.drop(own)
    i, d = free(once, "_id"), free(once, "_d")
    twice = small_or_not(repeated.select(F.col("doc_id").alias(i), F.col(own).alias(d)))
    rows = once.join(twice, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(d)), "left_semi")
    first = rows.groupBy(keys).agg(F.min_by(F.struct(*docs.columns), F.struct(*[orderable(rows, c) for c in ("text", *[c for c in docs.columns if c != "text"])])).alias(i))
    return _without(once, repeated, keys).drop(own).unionByName(first.select(f"{i}.*").select(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at Jaccard 0.75 over five-word shingles, the one with the smallest doc_id stays (a null id is the largest)."""
    key, rows = "doc_id", docs
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        # Ids do not name rows: their places in the order of ids do.
        key = free(docs, "_place")
        order = [F.col("doc_id").asc_nulls_last(), *[orderable(docs, c) for c in docs.columns if c != "doc_id"]]
        rows = save(docs.orderBy(order).withColumn(key, F.monotonically_increasing_id()), "pipeline-places")
    found = ngram_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"))
    near = save(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)), "pipeline-near")
    return _without(rows, near, [key]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    names = tuple(free(docs, n) for n in decontaminate.NAMES)
    return decontaminate.remove_documents(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), names=names), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their ids and places in sequences of 2048 tokens."""
    return packing.pack(docs, capacity=2048, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
