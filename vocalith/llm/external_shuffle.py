"""Sharding by a two-pass external shuffle, in DataFrame functions only.

The first pass scatters the records by a seeded hash into buckets of about a fixed number of bytes; the second shuffles
each bucket by Fisher-Yates (Spark's own `shuffle`), numbers the whole order through the buckets' counts and cuts it
into shards whose row counts differ by one at most. Every bucket is written where it was shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small_or_not

BUCKET_BYTES = 8 << 20
#: Buckets that a task of the second pass takes at most, on average, and buckets whose counts are added up together.
TASK_BUCKETS, RUN = 8, 4096


def external_shuffle(docs: DataFrame, n_shards: int, text: str = "text", key: str = "doc_id", seed: int = 20240, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs with `shard` (0 to n_shards-1) and `slot` (gapless from 0 in each shard), in random order.

    Law `rows`: shard sizes differ by one row at most. Null texts and keys are records like any other; repeated rows
    stay apart, as a row's position goes into its hash, so that no key makes a bucket larger than its share. With fewer
    rows than shards, some shards stay empty; an empty table gives an empty table. A bucket is as large as bucket_bytes
    plus chance, or one record, if that is larger. Columns `shard` and `slot` of docs are replaced. docs must number its rows alike
    each time it is read, as a scan does; write other plans to a table first.
    """
    spark, docs = docs.sparkSession, docs.drop("shard", "slot")
    names = docs.columns
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 64).alias("b"), F.count(F.lit(1)).alias("n")).first()
    rows, n_buckets = total.n, max(1, math.ceil((total.b or 0) / bucket_bytes))
    at = F.monotonically_increasing_id()  # follows from the files, so a task that runs again gives the same
    # Two draws: the bucket, and the order in which a bucket is gathered, so that its shuffle always begins alike.
    drawn = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), F.col(key), at), F.lit(n_buckets)).cast("int").alias("_bucket"),
        F.struct(F.xxhash64(F.lit(seed + 1), F.col(key), at).alias("h"), at.alias("at")).alias("_order"),
        F.struct(*names).alias("_row"),
    )
    counts = drawn.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # Two levels: the counts of a run of buckets, then of the buckets inside it.
    counts = counts.withColumn("_run", F.expr(f"_bucket div {RUN}"))
    before = lambda by, order: by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("_run").agg(F.sum("_n").alias("_m"))  # a row for RUN buckets
    runs = runs.select("_run", F.coalesce(F.sum("_m").over(before(Window.partitionBy(), "_run")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_run"), "_bucket")), F.lit(0))
    offsets = counts.withColumn("_in", inside).join(runs, "_run").select("_bucket", (F.col("_start") + F.col("_in")).alias("_offset"))
    gathered = drawn.repartition(max(partitions(spark), -(-n_buckets // TASK_BUCKETS)), "_bucket").groupBy("_bucket").agg(F.collect_list(F.struct("_order", "_row")).alias("_records"))
    if "map<" in docs.schema.simpleString():  # rows that have no order: only the draws are compared
        by_draw = lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0)
        gathered = gathered.select("_bucket", F.array_sort("_records", by_draw).alias("_records"))
    else:
        gathered = gathered.select("_bucket", F.sort_array("_records").alias("_records"))
    # Sorted so that each partition's random numbers meet the same buckets in the same order.
    mixed = gathered.sortWithinPartitions("_bucket").select("_bucket", F.posexplode(F.shuffle("_records", seed)).alias("_at", "_r"))
    placed = mixed.join(small_or_not(offsets), "_bucket").withColumn("_pos", F.col("_offset") + F.col("_at"))
    placed = placed.withColumn("shard", F.expr(f"cast(((_pos + 1) * {n_shards} - 1) div {max(rows, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {rows}) div {n_shards}")
    return placed.withColumn("slot", F.col("_pos") - first).select("_r._row.*", "shard", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; each task writes the shards that its own buckets reach, and nothing moves again."""
    shuffled.write.partitionBy("shard").option("compression", "zstd").parquet(path)
