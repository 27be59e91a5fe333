"""Resampling in blocks against a plain statement of it."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.operators import resample, routing, stats


def mixed(x):
    for by, times in ((16, resample.MIX_1), (13, resample.MIX_2), (16, 1)):
        x = (x ^ x >> by) * times % 2**32
    return x


def plain_picks(name, n, size):
    d = hashlib.md5(name.encode()).hexdigest()
    return [mixed(mixed((int(d[:8], 16) + i * resample.STEP) % 2**32) ^ int(d[8:16], 16)) % size for i in range(n)]


def test_picks():
    for name, n, size in (("1:g:0", 50, 50), ("x", 7, 3), ("", 1, 1), ("y", 0, 5)):
        assert resample.picks(name, n, size).tolist() == plain_picks(name, n, size)
    share = np.bincount(resample.picks("even", 200_000, 10), minlength=10) / 200_000
    assert abs(share - 0.1).max() < 0.005
    together = np.corrcoef([np.bincount(resample.picks(f"r:{r}", 2_000, 2_000), minlength=2_000) for r in range(40)])
    assert abs(together[~np.eye(40, dtype=bool)]).max() < 0.12  # replicates are no copies of each other


@pytest.mark.parametrize("block", [1 << 16, 4])
def test_every_replicate_draws_as_many_as_there_are(block):
    for n in (1, 3, 4, 5, 30):
        for r in range(40):
            m = [resample.multiplicities(f"s:{r}", n, b, block) for b in range(-(-n // block))]
            assert sum(map(len, m)) == n and sum(x.sum() for x in m) == n
    m = np.array([np.concatenate([resample.multiplicities(f"s:{r}", 30, b, block) for b in range(-(-30 // block))]) for r in range(4000)])
    assert abs(m.mean(axis=0) - 1).max() < 0.1 and abs(m.var(axis=0) - 29 / 30).max() < 0.15


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_sums(spark, block):
    """Several rows and cells of a unit, null values, null keys, a group of one unit."""
    rows = [(g, f"u{u}", c, float(u * 10 + c) if u != 5 else None) for g, n in (("a", 11), ("b", 1), (None, 4)) for u in range(n) for c in (range(3) if u % 2 else range(2))]
    df = spark.createDataFrame(rows, "g string, u string, c int, x double")
    keyed = df.withColumn("g", F.coalesce("g", F.lit("none")))
    got = {(r.g, r.c, r.replicate): r.sums for r in resample.resampled_sums(keyed.repartition(5), ["g"], ["u"], [F.col("x"), F.lit(1)], 20, 9, cell="c", block_size=block).collect()}
    order = lambda u: (int(hashlib.md5(f"0:{u}".encode()).hexdigest()[:13], 16), u)
    for g, n in (("a", 11), ("b", 1), ("none", 4)):
        names = sorted((f"u{u}" for u in range(n)), key=order)
        for r in range(20):
            m = Counter()
            for b in range(-(-n // block)):
                m.update(dict(zip(names[b * block :], resample.multiplicities(f"9:{g}:{r}", n, b, block).tolist())))
            for c in range(3):
                mine = [(u, x or 0.0) for k, u, of, x in rows if (k or "none") == g and of == c]
                if mine:
                    assert got.pop((g, c, r)) == [sum(m[u] * x for u, x in mine), sum(m[u] for u, _ in mine)]
    assert not got


def test_a_million_units(spark):
    """What leaves the units is a row per block and replicate, and each replicate draws a million."""
    units = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("speaker"), F.lit(1).alias("errors_a"), (F.col("id") % 2).alias("errors_b"), F.lit(2).alias("words"))
    sums = resample.resampled_sums(units, ["g"], ["speaker"], [F.col(c) for c in ("errors_a", "errors_b", "words")], 12, 1)
    assert all(r.sums[0] == 1_000_000 and r.sums[2] == 2_000_000 and abs(r.sums[1] - 500_000) < 4_000 for r in sums.collect())
    assert "Generate" not in sums._jdf.queryExecution().toString()
    assert stats.paired_bootstrap(units.limit(0), ["g"], 5).count() == 0


def test_limits_without_replicates(spark):
    """A layer that one side lacks has a row with null limits."""
    rows = [("m", s, f"{s}{u}", layer, 1.0, [0.5, 0.5]) for s in ("adult", "child") for u in range(3) for layer in ((0, 1) if s == "adult" else (0,))]
    df = spark.createDataFrame(rows, "model string, age_group string, utterance_id string, layer_idx int, duration_sec double, probs array<double>")
    boot = routing.jsd_bootstrap(df, ["model"], 10, experts=2)
    got = {r.layer_idx: (r.ci_low, r.ci_high) for r in routing.ci_table(boot.where("jsd is not null"), ["model", "layer_idx"], df).collect()}
    assert got == {0: (0.0, 0.0), 1: (None, None)}
    assert {r.layer_idx for r in routing.ci_table(boot.where("jsd is not null"), ["model", "layer_idx"]).collect()} == {0}


def test_distribution_without_durations(spark):
    """Without the duration column all rows weigh alike."""
    df = spark.createDataFrame([("k", [1.0, 0.0]), ("k", [0.0, 1.0]), ("k", [1.0, 0.0]), ("k", [1.0, 0.0])], "k string, probs array<double>")
    assert {r.expert: r.p for r in routing.weighted_distribution(df, ["k"]).collect()} == {0: 0.75, 1: 0.25}
