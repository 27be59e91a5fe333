"""Shared helpers: the shared work folder, size-checked broadcasts, table loading."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay under this bound (narrow rows of a few longs).
BROADCAST_ROWS = 1_000_000

_own_folder: dict[str, str] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _own_folder[app]
    return base.rstrip("/")


_made: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored_tables(spark: SparkSession) -> list[str]:
    """The folders that operators have written for this application and that were not removed."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def remove_stored(spark: SparkSession) -> None:
    """Delete these folders; frames that operators returned, and that were not read to their end, can't be read any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, for jobs that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Few rows at a time to Python, where rows are texts or sets: what a worker and the executor hold follows the batch.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast when it has at most limit rows; larger ones keep Spark's shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores before it as it takes not to meet a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def orderable(df: DataFrame, name: str) -> Column:
    """A column, or its JSON where its type holds a map, which Spark can neither order nor group."""
    return F.to_json(F.struct(df[name])) if "map<" in df.schema[name].dataType.simpleString() else df[name]


def release() -> None:
    """Give memory that a Python worker holds but does not use back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more: it does so as the driver collects garbage, first here, then there."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: The letters that the contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
