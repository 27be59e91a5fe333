"""JSON maps of any size as rows.

A map is read as text whose lines end at a quotation mark, so Spark cuts the file into blocks and no task holds more than
an entry. Whether a block begins inside a string follows from the number of marks before it: they are counted block by
block first. Then each block yields its whole entries; what it has before its first entry and after its last one meets
the neighbouring blocks in one small step per file.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks that begin inside a string and are named to all tasks, at most.
BLOCKS = 1 << 20
#: Stretches of a block: up to where its first entry begins, a whole entry, from where its last entry begins, and all of a block in which none begins.
HEAD, ENTRY, TAIL, MIDDLE = range(4)
_ROWS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("raw", pa.string()), ("key", pa.string()), ("value", pa.string())])


def closed(piece: str) -> bool:
    """Does the mark behind this piece count? Behind an odd number of backslashes it does not."""
    return (len(piece) - len(piece.rstrip("\\"))) % 2 == 0


def entry(raw: str) -> tuple[str, str | None] | None:
    """The entry in a stretch from the mark that opens a key to the comma or bracket behind its value; None for an empty map."""
    found = json.loads("{" + raw.strip().rstrip(",}") + "}")
    if len(found) > 1:
        raise ValueError(f"not one entry of a map: {raw[:200]}")
    return next(((k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in found.items()), None)


class Block:
    """The stretches of a block, piece by piece; inside: it begins within a string."""

    def __init__(self, inside: bool):
        self.inside, self.held, self.place = inside, [], MIDDLE

    def feed(self, piece: str):
        if not self.inside and any(c in piece for c in ",{}"):  # an entry ends here, and another may begin
            self.held.append(piece)
            if self.place != ENTRY:
                yield HEAD if self.place == MIDDLE else ENTRY, "".join(self.held)
            # Behind the last bracket nothing is held.
            self.place, self.held, self.inside = (ENTRY, [], False) if "}" in piece else (TAIL, ['"'], True)
            return
        self.held.append(piece + '"')
        if closed(piece):
            self.inside = not self.inside

    def end(self):
        if self.place != ENTRY:
            yield self.place, "".join(self.held)


def _stitched(table: pa.Table) -> pa.Table:
    """The entries of a file that lie in several blocks, from what the blocks have left over."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "place", "raw"))))
    file, out, held = table.column("file")[0].as_py(), [], None
    if not rows[0][2].lstrip().startswith("{"):
        raise ValueError(f"{file} is not a map")
    for _, place, raw in rows:
        if place == TAIL:
            held = [raw]
        elif held is not None:
            held.append(raw)
            if place == HEAD:
                out.append(entry("".join(held)))
                held = None
    if held is not None:
        raise ValueError(f"{file} ends within an entry")
    found = [x for x in out if x is not None]
    return pa.table([pa.array([file] * len(found), pa.string()), pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["file", "key", "value"])


def read_maps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, key, value) of every entry of JSON maps, in files or in folders of them; bad JSON fails the job.

    Values are strings, null, or other scalars as JSON. Files are cut as any text is, at spark.sql.files.maxPartitionBytes.
    """
    read = spark.read.option("lineSep", '"').option("recursiveFileLookup", True).text(paths)
    pieces = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    marks = F.count_if(F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2 == 0)
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row per block
    odd = pieces.groupBy("file", "block").agg(marks.alias("n")).withColumn("b", before).where("b % 2 = 1").select("file", "block").limit(BLOCKS + 1).collect()
    if len(odd) > BLOCKS:
        raise ValueError("the maps have too many blocks: raise spark.sql.files.maxPartitionBytes")
    sent = spark.sparkContext.broadcast(frozenset(map(tuple, odd)))

    def stretches(batches):
        at, block = None, None
        for batch in batches:
            for value, *here in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if here != at:
                    yield from ((at, x) for x in (block.end() if block else ()))
                    at, block = here, Block(tuple(here) in sent.value)
                yield from ((at, x) for x in block.feed(value))
        yield from ((at, x) for x in (block.end() if block else ()))

    def run(batches):
        out = []
        for at, (place, text) in stretches(batches):
            pair = entry(text) if place == ENTRY else None
            if place != ENTRY or pair is not None:
                out.append((*at, place, *((None, *pair) if pair else (text, None, None))))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)

    found = pieces.mapInArrow(run, "file string, block long, place int, raw string, key string, value string")
    loose = found.where(F.col("place") != ENTRY).groupBy("file").applyInArrow(_stitched, "file string, key string, value string")
    return found.where(F.col("place") == ENTRY).select("file", "key", "value").unionByName(loose)
