"""Jobs over groups of any size against plain statements: Benjamini-Hochberg, running totals, clip packing."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from vocalith.operators import corpus, ranks, routing, stats
from vocalith.plans import catalog


def plain_bh(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, least = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        least = min(least, ps[i] * len(ps) / rank)
        out[i] = max(0.0, least)
    return out


@pytest.mark.parametrize("ranges", [256, 3])
def test_fdr_in_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(ranks, "VALUE_RANGES", ranges)
    rng = random.Random(1)
    tests = {"a": [rng.random() ** 3 for _ in range(300)], "b": [rng.choice([0.0, 0.01, 0.01004, 0.5, 1.0]) for _ in range(200)], None: [0.2, 0.1], "one": [0.03]}
    rows = [(f, i, p) for f, ps in tests.items() for i, p in enumerate(ps)] + [("a", -1, None), ("a", -2, float("nan")), ("gone", 0, None)]
    df = spark.createDataFrame(rows, "f string, i int, p double")
    for rounded in (False, True):
        got = {(r.f, r.i): (r.p_adj, r.significant) for r in stats.fdr_over_family(df.repartition(3), ["f"], rounded=rounded).collect()}
        for f, ps in tests.items():
            want = plain_bh([round(p, 4) for p in ps] if rounded else ps)
            for i, w in enumerate(want):
                p_adj, significant = got.pop((f, i))
                assert abs(p_adj - w) < 1e-12 and significant == (p_adj <= 0.05)
        assert got == {("a", -1): (None, None), ("a", -2): (None, None), ("gone", 0): (None, None)}
    assert stats.fdr_over_family(df.limit(0), ["f"]).count() == 0


def test_fdr_of_a_large_family(spark):
    """A million tests of one family, a third of them with one p; no window holds the family."""
    df = spark.range(1_000_000).select(F.lit("f").alias("f"), F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 1.0).otherwise((F.col("id") + 1) / 1_000_000.0).alias("p"))
    out = stats.fdr_over_family(df, ["f"], q=0.9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and all("_r" in line for line in plan.splitlines() if "Window [" in line)
    r = out.agg(F.count(F.lit(1)).alias("n"), F.count("p_adj").alias("m"), F.max("p_adj").alias("most"), F.countDistinct(F.when(F.col("i") % 3 == 0, F.col("p_adj"))).alias("tied")).first()
    assert (r.n, r.m, r.most, r.tied) == (1_000_000, 1_000_000, 1.0, 1)
    want = plain_bh([1.0 if i % 3 == 0 else (i + 1) / 1_000_000.0 for i in range(1_000_000)])
    assert all(abs(r.p_adj - want[r.i]) < 1e-9 for r in out.where("i % 9973 = 0").collect())


@pytest.mark.parametrize("ranges", [256, 4])
def test_running_total(spark, monkeypatch, ranges):
    monkeypatch.setattr(ranks, "VALUE_RANGES", ranges)
    rng = random.Random(2)
    rows = [(g, f"/data/{g}/{rng.choice('abcäü')}{rng.randint(0, 99999):05d}.wav", rng.randint(0, 50), float(rng.randint(1, 9)), f"t{i}") for i, g in enumerate(rng.choices(["s", "s", "t", None, "u"], k=400))]
    rows += [("same", "/data/x.wav", 1, 2.0, f"t{i:03d}") for i in range(20)] + [("one", "", 1, 1.0, "t")]
    df = spark.createDataFrame(rows, "g string, path string, number int, d double, text string")
    for order in ("path", "number"):
        got = {(r.g, r.text): r._before for r in ranks.running_total(df.repartition(5), ["g"], [order, "text"], "d").collect()}
        k = 1 if order == "path" else 2
        for g in {r[0] for r in rows}:
            total = 0.0
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[k].encode() if k == 1 else r[k], r[4])):
                assert got[g, r[4]] == total
                total += r[3]


def test_running_total_over_estimated_edges(spark):
    """Rows that lie elsewhere each time they are read give other estimates of the edges; totals are those of a plain pass."""
    n, dealt = 50_000, F.udf(lambda i: random.random(), "double").asNondeterministic()
    df = spark.range(n).select(F.lit("s").alias("g"), (F.col("id") * 7919 % n).alias("number"), F.lit(1.0).alias("d")).repartition(6, dealt("id"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ranks.running_total(df, ["g"], ["number"], "d").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == n and all(r._before == r.number for r in got)


def test_packs_of_odd_clips_are_those_of_the_sql(spark, tmp_path):
    """Clips of no, unknown or negative length, speakers and ids that are null or repeated."""
    rows = [(i, "s", 0 if i % 3 else 7000 + i) for i in range(60)] + [(i, "t", None if i % 2 else 9000) for i in range(60, 90)] + [(90, "u", None)]
    rows += [(i, "v", -30000 if i < 105 else 7000) for i in range(100, 130)] + [(i // 3, None, 8001) for i in range(30)] + [(i, "", 8001) for i in range(3)]
    rows += [(None if i == 150 else i, "w", 7001) for i in range(145, 160)] + [(None, "x", 5)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(catalog.ORACLES["pack_short_clips"])
    names = [x[0] for x in res.description]
    want = Counter(res.fetchall())
    assert Counter(map(tuple, catalog.QUERIES["pack_short_clips"](spark, str(tmp_path)).select(*names).collect())) == want


def test_packs_of_one_speaker(spark):
    """All clips of one speaker lie in many ranges, and packs are those of a plain pass."""
    n = 20_000
    df = spark.range(n).select(F.lit("s").alias("speaker"), F.format_string("/data/s/%06d.wav", F.col("id")).alias("audio_filepath"), (F.col("id") % 4).cast("double").alias("duration"), F.format_string("t%d", F.col("id")).alias("text"))
    got = {r.pack: (r.clips, r.duration, r.text) for r in corpus.pack_short_clips(df, 30.0).collect()}
    want, before = {}, 0.0
    for i in range(n):
        if i % 4:
            want.setdefault(int(before // 30.0), []).append(i)
            before += i % 4
    assert got == {p: (len(x), float(sum(i % 4 for i in x)), " ".join(f"t{i}" for i in x)) for p, x in want.items()}
    placed = ranks.value_ranges(ranks.order_number(df, ["speaker"], "audio_filepath"), ["speaker"], "_v").groupBy("_r").count()
    assert placed.count() > 200 and placed.agg(F.max("count")).first()[0] < n / 50


@pytest.mark.parametrize("ranges", [256, 3])
def test_places_of_tied_values(spark, monkeypatch, ranges):
    """One value for all rows, one for a third of them: places have no gap, follow nothing but the rows, and no range holds all."""
    monkeypatch.setattr(ranks, "VALUE_RANGES", ranges)
    df = spark.range(30_000).select((F.col("id") % 2).cast("string").alias("g"), F.when((F.col("id") % 2 == 0) | (F.col("id") % 3 == 0), 7.0).otherwise(F.col("id") / 5).alias("v"), "id")
    got = ranks.numbered_by_value(df.repartition(7), ["g"], "v").collect()
    for g in "01":
        mine = sorted((r._i, r.v) for r in got if r.g == g)
        assert [i for i, _ in mine] == list(range(15_000)) and all(a[1] <= b[1] for a, b in zip(mine, mine[1:]))
    assert {(r.id, r._i) for r in got} == {(r.id, r._i) for r in ranks.numbered_by_value(df.repartition(3), ["g"], "v").collect()}
    kept = routing.linspace_subsample(df.where("g = '0'"), ["g"], "v", 100)
    assert kept.count() == 100 and kept.columns == ["g", "v", "id"]
    windows = [line for line in ranks.numbered_by_value(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number" in line]
    assert windows and all("_r#" in line for line in windows)


def test_spelling(spark):
    """Words that the map knows are written its way, also twice in a text; blank texts stay blank."""
    df = spark.createDataFrame([(1, "ala (x) ma koTa-"), (2, None), (3, "<a>"), (4, "ma ma")], "id int, t string")
    spelling = spark.createDataFrame([("koTa", "kota"), ("koTa", "kotb"), ("ma", "MA")], "sound string, word string")
    assert {r.id: r.t for r in corpus.spelled_transcription(df, "id", "t", spelling).collect()} == {1: "ala MA kota", 2: "", 3: "", 4: "MA MA"}


def test_cosines(spark):
    rows = [("l", f, e, v) for f in range(4) for e, v in enumerate([[1.0, 0.0], [0.0, 2.0], [3.0, 4.0], [0.0, 0.0]]) if (f, e) != (3, 2)]
    got = {(r.expert_a, r.expert_b): r.cosine for r in routing.cosine_matrix(spark.createDataFrame(rows, "k string, frame_idx int, expert int, vec array<double>"), ["k"]).collect()}
    unit = [(1, 0), (0, 1), (0.6, 0.8), (0, 0)]
    assert len(got) == 16 and all(abs(c - sum(x * y for x, y in zip(unit[a], unit[b]))) < 1e-12 for (a, b), c in got.items())
