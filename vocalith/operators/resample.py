"""Resampling with replacement without a row per replicate and unit.

Units of a group have places. A block of them is one group of an aggregate: it makes the multiplicities of its own units
for all replicates and returns, per replicate, their weighted sums, so that what leaves it is one short row per replicate.
How many of a replicate's draws fall into a block is one multinomial over the blocks, which every block draws alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from vocalith.operators.ranks import beside, numbered_by_hash

#: Units of a block, and multiplicities that a task makes at a time.
BLOCK, CELLS = 1 << 16, 1 << 22
#: The step between two slots and the multipliers that mix 32 bits.
STEP, MIX_1, MIX_2 = 2654435769, 2246822507, 3266489909


def _mix(x: np.ndarray) -> np.ndarray:
    """Mix 32 bits; products wrap."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX_1)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(MIX_2)
    return x ^ (x >> np.uint32(16))


def picks(name: str, n: int, size: int) -> np.ndarray:
    """n draws from range(size): slot i takes a number that follows from the MD5 of name and from i."""
    d = hashlib.md5(name.encode()).digest()
    first, second = (int.from_bytes(d[i : i + 4], "big") for i in (0, 4))
    slots = ((np.arange(n, dtype=np.uint64) * np.uint64(STEP) + np.uint64(first)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return (_mix(_mix(slots) ^ np.uint32(second)) % np.uint32(size)).astype(np.int64)


def multiplicities(name: str, n: int, block: int, block_size: int = BLOCK) -> np.ndarray:
    """How often a replicate of n draws from n units takes each unit of a block."""
    if n <= block_size:
        return np.bincount(picks(name, n, n), minlength=n)
    sizes = np.full(-(-n // block_size), block_size)
    sizes[-1] = n - block_size * (len(sizes) - 1)
    size = int(sizes[block])
    shares = np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.md5(name.encode()).digest(), "big"))).multinomial(n, sizes / n)
    return np.bincount(picks(f"{name}:{block}", int(shares[block]), size), minlength=size)


def resampled_sums(rows: DataFrame, keys: list[str], unit: list[str], values: list[Column], replicates: int, seed: int, cell: str | None = None, block_size: int = BLOCK) -> DataFrame:
    """(keys, cell, replicate, sums): the sums of the values over the units that each replicate draws, per key and cell.

    Units of a key are drawn with replacement, as many as there are; all rows of a unit go with it. Null values count as
    0. A cell whose units a replicate does not draw has zeros.
    """
    cells = [cell] if cell else []
    plain = rows.select(*keys, *[c for c in dict.fromkeys([*unit, *cells]) if c not in keys], F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values]).alias("_v"))
    if cell is None:
        placed = numbered_by_hash(plain, keys, F.concat_ws("/", *unit))
    else:
        ids = numbered_by_hash(plain.select(*keys, *unit).distinct(), keys, F.concat_ws("/", *unit))
        placed = beside(plain, ids, [*keys, *unit])
    name = F.concat_ws(":", F.lit(str(seed)), *keys)
    blocks = placed.select(*keys, *cells, name.alias("_name"), F.floor(F.col("ix") / block_size).cast("int").alias("_block"), (F.col("ix") % block_size).cast("int").alias("_at"), "n", "_v")
    schema = StructType([*[blocks.schema[c] for c in (*keys, *cells)], StructField("replicate", IntegerType()), StructField("sums", ArrayType(DoubleType()))])
    width = len(values)

    def run(table: pa.Table) -> pa.Table:
        name, n, block = (table.column(c)[0].as_py() for c in ("_name", "n", "_block"))
        size = min(block_size, n - block * block_size)
        at = table.column("_at").to_numpy()
        v = table.column("_v").combine_chunks().flatten().to_numpy().reshape(-1, width)
        groups = [(None, np.arange(len(at)))] if cell is None else [(c, np.flatnonzero(of == c)) for of in [table.column(cell).to_numpy()] for c in np.unique(of)]
        at_once = max(1, CELLS // size)
        out = []
        for begin in range(0, replicates, at_once):
            some = range(begin, min(replicates, begin + at_once))
            m = np.stack([multiplicities(f"{name}:{r}", n, block, block_size) for r in some]).astype(np.float64)
            for c, mine in groups:
                sums = m[:, at[mine]] @ v[mine]
                columns = [pa.array([table.column(k)[0].as_py()] * len(some), table.schema.field(k).type) for k in keys]
                columns += [pa.array([c] * len(some), table.schema.field(cell).type)] if cell else []
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(sums.ravel()))
                out.append(pa.table([*columns, pa.array(list(some), pa.int32()), flat], names=[*keys, *cells, "replicate", "sums"]))
        return pa.concat_tables(out)

    each = blocks.groupBy(*keys, "_block").applyInArrow(run, schema)
    summed = each.groupBy(*keys, *cells, "replicate").agg(*[F.sum(F.get("sums", i)).alias(f"_{i}") for i in range(width)])
    return summed.select(*keys, *cells, "replicate", F.array(*[f"_{i}" for i in range(width)]).alias("sums"))
