"""Places inside groups that may be larger than a task: rows are counted by ranges of an order, then numbered inside a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vocalith.sources.scratch import stored

#: Ranges of a value order; its edges are estimates, which shift the sizes of ranges but no place.
VALUE_RANGES = 256


def hash_order(seed: int, unit: str | Column = "utterance_id") -> Column:
    """A random order that Spark and any other engine agree on: 52 bits of an md5, in the upper bits of a long."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    return F.shiftleft(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), unit.cast("string")).cast("binary")), 1, 13), 16, 10).cast("bigint"), 11)


def hash_range(order: Column) -> Column:
    """One of 512 ranges of a hash order."""
    return F.shiftright(order, 54)


def beside(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the columns that small has for its keys; null keys meet."""
    named = small.select([F.col(k).alias(f"_key_{k}") for k in keys] + [c for c in small.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(F.col(f"_key_{k}"))
    return df.join(named, same, how).drop(*[f"_key_{k}" for k in keys])


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)


def below(df: DataFrame, value: str, name: str) -> DataFrame:
    """df, which has at most VALUE_RANGES - 1 rising edges in _e, with the number of edges under a value: a binary search, one column a step."""
    out, step = df.withColumn(name, F.lit(0)), (1 << (VALUE_RANGES - 1).bit_length()) >> 1
    while step:
        out = out.withColumn(name, F.col(name) + F.when(F.get("_e", F.col(name) + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return out


def value_edges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _e): the estimated edges of the ranges of a number inside each group. In a group of over 10,000 rows they follow the order in which tasks' parts meet, so they may differ where they are made twice."""
    marks = [i / VALUE_RANGES for i in range(1, VALUE_RANGES)]
    return df.groupBy(*keys).agg(F.percentile_approx(value, marks, 10_000).alias("_e"))


def value_ranges(df: DataFrame, keys: list[str], value: str, edges: DataFrame | None = None) -> DataFrame:
    """df with `_r`, one of VALUE_RANGES ranges of a number inside its group; equal values share one. edges: those of value_edges, stored, if several branches of a plan are to have the same ranges."""
    return below(beside(df, value_edges(df, keys, value) if edges is None else edges, keys), value, "_r").drop("_e")


def over_ranges(per: DataFrame, keys: list[str], value: str, name: str, total: str | None = None, later: bool = False) -> DataFrame:
    """(keys, _r, name[, total]): the sum of the values of the ranges before each and of all, or with later the least of those after it (null for the last).

    per has one row per range, so a group is one array of at most VALUE_RANGES + 1 entries.
    """
    held = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(value).alias("x")))).alias("_a"))
    zero = F.lit(0).cast(per.schema[value].dataType)
    added = lambda some: F.aggregate(some, zero, lambda s, e: s + e["x"])
    if later:
        other = lambda i: F.array_min(F.transform(F.slice("_a", i + 2, F.size("_a")), lambda e: e["x"]))
    else:
        other = lambda i: added(F.slice("_a", F.lit(1), i))
    each = F.transform("_a", lambda e, i: F.struct(e["_r"].alias("_r"), other(i).alias("y")))
    sums = [added(F.col("_a")).alias(total)] if total else []
    return held.select(*keys, *sums, F.explode(each).alias("_x")).select(*keys, F.col("_x._r").alias("_r"), F.col("_x.y").alias(name), *([total] if total else []))


def order_number(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with `_v`, a number that never falls where the order rises: the value, or six bytes of a text behind what all texts of its group begin with; nulls come last."""
    last = F.lit(float("inf"))
    if not isinstance(df.schema[order].dataType, StringType):
        return df.withColumn("_v", F.coalesce(F.col(order).cast("double"), last))
    ends = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    alike = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_lo"), F.length("_hi")))), lambda i: F.substring("_lo", F.lit(1), i) == F.substring("_hi", F.lit(1), i))
    both = beside(df, ends.select(*keys, F.size(alike).alias("_n")), keys)
    six = F.substring(F.encode(F.substring(F.col(order), F.col("_n") + 1, F.lit(6)), "UTF-8"), 1, 6)
    return both.withColumn("_v", F.coalesce(F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("double"), last)).drop("_n")


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str = "_before") -> DataFrame:
    """df with the total of an amount over the rows of its group that stand before it; order: columns, nulls last, the first of which parts the group into ranges.

    A segmented scan with carry: sums of ranges, what is carried into each, then the rows inside a range. Amounts add up as
    doubles; null counts as 0. The edges of the ranges are stored, as the carry and the rows must part at the same ones.
    """
    own, numbered = F.coalesce(F.col(amount).cast("double"), F.lit(0.0)), order_number(df, keys, order[0])
    edges = stored(value_edges(numbered, keys, "_v").withColumn("_e", F.array_distinct("_e")), "edges")
    rows = value_ranges(numbered, keys, "_v", edges).withColumn("_w", own).drop("_v")
    carried = over_ranges(rows.groupBy(*keys, "_r").agg(F.sum("_w").alias("_s")), keys, "_s", "_carry")
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy(*keys, "_r").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = beside(rows.withColumn("_i", inside), carried, [*keys, "_r"])
    return placed.withColumn(name, F.col("_carry") + F.col("_i")).drop("_r", "_w", "_i", "_carry")


def _numbered(df: DataFrame, keys: list[str], order: list[Column], place: str, size: str) -> DataFrame:
    """df, which has its range in _r, with the place of each row (from 0) and the size of its group; _r goes."""
    per = df.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_c"))  # a few rows per group
    per = per.withColumns({"_b": F.coalesce(F.sum("_c").over(_before(keys)), F.lit(0)), size: F.sum("_c").over(Window.partitionBy(*keys))}).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(*order)) - 1
    return beside(df.withColumn("_p", inside), per, [*keys, "_r"]).withColumn(place, F.col("_b") + F.col("_p")).drop("_r", "_b", "_p")


def numbered_by_hash(df: DataFrame, keys: list[str], unit: Column, place: str = "ix", size: str = "n", seed: int = 0) -> DataFrame:
    """df with the place of each row in the hash order of its unit, equal hashes by the unit, and the size of its group."""
    u = df.withColumn("_u", unit).withColumn("_o", hash_order(seed, "_u")).withColumn("_r", hash_range(F.col("_o")))
    return _numbered(u, keys, [F.col("_o"), F.col("_u")], place, size).drop("_o", "_u")


#: Parts of the rows that share a value which is an edge of ranges.
TIED = 64


def numbered_by_value(df: DataFrame, keys: list[str], value: str, place: str = "_i", size: str = "_n") -> DataFrame:
    """df with the place of each row in the order of a number and the size of its group; equal values stand by a hash of their rows.

    Ranges lie between estimated edges. A value that many rows share is an edge, so its rows are a range of their own, and
    such a range is dealt by hash: no task sees more than a part of it.
    """
    marks = [i / VALUE_RANGES for i in range(1, VALUE_RANGES)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, marks, 10_000).alias("_e"))
    both = below(beside(df.withColumns({"_h": F.xxhash64(*df.columns), "_h2": F.hash(*df.columns)}), edges, keys), value, "_b")
    tied = F.get("_e", "_b") == F.col(value)
    part = F.shiftright("_h", 58) + TIED // 2  # in the order of the hash
    ranged = both.withColumn("_r", 2 * TIED * F.col("_b") + F.when(tied, TIED + part).otherwise(0)).drop("_e", "_b")
    return _numbered(ranged, keys, [F.col(value), F.col("_h"), F.col("_h2")], place, size).drop("_h", "_h2")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, quantile): exact quantiles with linear interpolation, of which no task sees more than a range of values."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    held = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    marks = [i / VALUE_RANGES for i in range(1, VALUE_RANGES)]
    edges = held.agg(F.percentile_approx("v", marks, 10_000).alias("_e"))
    ranged = below(held.crossJoin(edges), "v", "_r").drop("_e")  # one row of edges
    per = ranged.groupBy("_r").agg(F.sum("c").alias("_c")).withColumns({"_b": F.coalesce(F.sum("_c").over(_before([])), F.lit(0)), "n": F.sum("_c").over(Window.partitionBy())}).drop("_c")
    inside = F.sum("c").over(Window.partitionBy("_r").orderBy("v"))
    placed = ranged.withColumn("_s", inside).join(per, "_r").withColumn("last", F.col("_b") + F.col("_s") - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    # A value answers for the shares whose lower or upper neighbour lies among its places.
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("share"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares)]))
    met = placed.select("v", "first", "last", wanted.alias("w")).where(F.col("w.at") >= F.col("first") - 1).where(F.col("w.at") <= F.col("last") + 1)
    low, high = F.floor("w.at"), F.ceil("w.at")
    pick = lambda x: F.max(F.when(x.between(F.col("first"), F.col("last")), F.col("v")))
    both = met.groupBy("w.i", "w.share").agg(pick(low).alias("lo"), pick(high).alias("hi"), F.max(F.col("w.at") - low).alias("part"))
    return both.select("i", "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("quantile"))
