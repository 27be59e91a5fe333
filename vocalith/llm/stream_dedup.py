"""Exact deduplication with stateful streaming.

The table's files are a stream. Keyed state on disk (RocksDB), without expiry, holds for each digest of a normalised
text the group's size, the stable identifier (the largest id) and the locator of its content (file and row). Partial
sums before the shuffle make a hot digest one row per task. State, checkpoint and groups live in one folder: a run that
is given the folder of an earlier one reads only files that are new, and goes on where that one stopped.

Hits are checked on full bytes. The rows of a digest that occurs more than once are read once more, by their locators,
and grouped by digest and bytes; equal bytes fall together in each task before any are shuffled, so a hot text is
shipped once per task. Where a digest stands for several texts, the bytes tell them apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from .common import ascii_lower, fresh_path, save, settings, small_or_not

#: The state lives in RocksDB; without fallocate a store with few keys takes few bytes, however many partitions there are.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_GROUPS = "digest string, keep struct<doc_id:bigint,file:string,row:bigint>, group_size bigint"


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _plain(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, body, file, row) of a scan of files: the normalised text and where it is."""
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return df.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _pattern(path: str, folder_or_file: bool = False) -> str:
    """path as a pattern that means just this path; a stream takes a plain path for a folder, a pattern for folder or file."""
    quoted = re.sub(r"([\\{}\[\]*?])", r"\\\1", path)
    return f"{path[:-1]}[{path[-1]}]" if folder_or_file and quoted == path else quoted


def scan_files(spark: SparkSession, path: str, key: str, text: str) -> DataFrame:
    """The two columns of the files at path; columns that are not read can't hide the files' metadata, whatever their names."""
    found = spark.read.parquet(_pattern(path)).schema
    return spark.read.schema(StructType([found[c] for c in dict.fromkeys((key, text))])).parquet(_pattern(path))


#: Files of any age are read, also ones that are older than what the state has seen; their names are never forgotten.
_ANY_AGE = "365000d"


def run_state(scan: DataFrame, path: str, state: str, key: str, text: str, digest=sha256_digest, files_per_batch: int = 512) -> DataFrame:
    """Stream the files below path that the state has not seen through it: (digest, keep, group_size) of every digest so far.

    keep is the identifier and locator of the row that stays. path: a file or a folder. state: a folder that all executors share.
    """
    spark, out = scan.sparkSession, f"{state}/groups"
    if _pattern(path) != path:
        files_per_batch = 1  # where names look like patterns, Spark's stream reads a batch of several files several times
    with settings(spark, _STATE):
        stream = spark.readStream.schema(scan.schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", _ANY_AGE).parquet(_pattern(path, folder_or_file=True))
        rows = _plain(stream, key, text).select("doc_id", "file", "row", digest(F.col("body")).alias("digest"))
        groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        # A batch that runs again overwrites its own folder.
        sink = groups.writeStream.outputMode("update").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
        sink.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], _GROUPS).write.mode("overwrite").parquet(f"{out}/epoch=-1")
    updates = spark.read.schema(_GROUPS).parquet(out)
    return updates.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def dedup_files(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest=sha256_digest, state: str | None = None, files_per_batch: int = 512) -> DataFrame:
    """exact_dedup of all rows of the Parquet files at path; state: the folder of an earlier run over them, to go on with.

    Fails where the state and the files do not hold the same rows: files that an earlier run read must not change or go.
    """
    path = path.rstrip("/")
    scan = scan_files(spark, path, key, text)
    groups = save(run_state(scan, path, state or fresh_path(spark, "dedup-state"), key, text, digest, files_per_batch), "dedup-groups")
    rows = save(_plain(scan, key, text).select("doc_id", "file", "row", digest(F.col("body")).alias("digest")), "dedup-digests")
    known, held = groups.agg(F.sum("group_size").alias("n")).first().n or 0, rows.count()
    if known != held:
        raise ValueError(f"the state knows {known} rows, the files at {path} hold {held}: a file was changed or removed, or was not read")
    # Of rows that a hit may be, the whole bytes.
    shared = groups.where("group_size > 1").select("digest")
    hits = rows.join(small_or_not(shared), "digest", "left_semi").select("file", "row")  # a hot digest is a skewed join, which adaptive execution splits
    held = _plain(scan, key, text).join(small_or_not(hits), ["file", "row"], "left_semi").withColumn("digest", digest(F.col("body")))
    texts = held.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    broken = save(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-broken")
    if broken.isEmpty():
        verified = _met(rows.join(groups, "digest", "left"))
    else:
        verified = _split(_plain(scan, key, text).withColumn("digest", digest(F.col("body"))), groups, broken)
    return verified.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _split(rows: DataFrame, groups: DataFrame, broken: DataFrame) -> DataFrame:
    """The same table when a digest stands for several texts: the rows of these digests are grouped by digest and bytes."""
    inside = rows.join(broken, "digest", "left_semi").select("doc_id", "digest", "body")
    exact = inside.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    inside = inside.join(exact, ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size")
    outside = _met(rows.select("doc_id", "digest").join(broken, "digest", "left_anti").join(groups, "digest", "left"))
    return inside.unionByName(outside)


def _met(joined: DataFrame) -> DataFrame:
    """Rows beside their groups; the job fails at a row whose digest the state never met."""
    size = F.when(F.col("group_size").isNull(), F.raise_error(F.concat(F.lit("the state never met the digest "), "digest")).cast("bigint")).otherwise(F.col("group_size"))
    return joined.select("doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), size.alias("group_size"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256_digest) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for every row of docs, whose two columns are written as files first.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays; of
    rows that share this id and text, each counts as kept (they are the same document twice); a null id never wins over
    another, and a group of null ids only is kept whole. An empty table gives an empty table. Extra columns are ignored.
    """
    path = fresh_path(docs.sparkSession, "dedup-docs")
    docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).write.option("compression", "zstd").parquet(path)
    return dedup_files(docs.sparkSession, path, digest=digest)
