"""Table-driven cases, invariants and comparisons with plain statements of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.operators import align, corpus, routing, score, stats
from vocalith.plans import catalog
from vocalith.sources import io


def apply(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    cases = {0: "zero", 13: "thirteen", 20: "twenty", 21: "twenty one", 100: "one hundred", 101: "one hundred one", 115: "one hundred fifteen", 999: "nine hundred ninety nine", 1000: "one thousand", 1001: "one thousand one", 9999: "nine thousand nine hundred ninety nine", 10000: "10000"}
    df = spark.createDataFrame([(n,) for n in cases], "n bigint")
    assert {r.n: r.w for r in df.select("n", T.int_to_english_words(F.col("n")).alias("w")).collect()} == cases


def test_norm_modes(spark):
    basic = {"<laugh> hi": "hi", "+um+ hi": "hi", "+a+ b +c+": "b", "<a> +b+": "", "": "", "   ": "", None: "", "It's A-B c": "it's a b c", "żółć": ""}
    assert apply(spark, T.norm_basic, basic) == [v if k != "żółć" else "" for k, v in basic.items()]
    num = {"I have 21 cats": "i have twenty one cats", "0012345 x": "12345 x", "a1b 7": "a1b seven", "99999999999999999999999": "99999999999999999999999", "10000": "10000", "0": "zero", "3,5": "three five", "<1> 2": "two"}
    assert apply(spark, T.norm_basic_num, num) == list(num.values())
    german = {"Straße": "strasse", "Äpfel": "aepfel", "ä": "ae", "１２": "12", None: ""}
    assert apply(spark, T.norm_german, german) == list(german.values())
    polish = {"Żółć": "żółć", "a-b": "a b", "_": "_", "<x> 'y'!": "'y'"}
    assert apply(spark, T.norm_polish, polish) == list(polish.values())
    light = {"  A, B\n": "a, b", None: ""}
    assert apply(spark, T.norm_light, light) == list(light.values())
    assert apply(spark, T.norm_raw, ["  x y\n"]) == ["x y"]
    assert apply(spark, T.n_words, ["", "a  b", None]) == [0, 2, 0] and apply(spark, T.first_word, ["", " b a"]) == ["", "b"]
    df = spark.createDataFrame([("A1 2",)], "t string")
    assert T.normalize_transcripts(df, ["t"], F.upper).first().t == "A1 2" and T.normalize_transcripts(df, ["t"]).first().t == "a1 two"


def test_paths_and_speakers(spark):
    rows = [("librispeech", "8224-274381-0000.wav", "8224"), ("myst", "/x/myst_002116_2014-01.flac", "002116"), ("jasmin", "fn000071_00001.wav", "fn000071"), ("kidstalc", "K003_1-K3-0.wav", "K003"), ("pavsig", "a/00097/00097-1-audio/bocian.wav", "00097"), ("other", "d/u1.wav", "u1"), ("myst", "plain.wav", "plain"), ("pavsig", "b.wav", "b")]
    df = spark.createDataFrame([(d, p, None) for d, p, _ in rows] + [("myst", "a_b.wav", "unknown"), ("myst", "a_b.wav", "me")], "dataset string, audio_filepath string, speaker string")
    assert [r.speaker for r in T.attach_speaker(df).collect()] == [*(s for *_, s in rows), "b", "me"]
    assert [r.speaker for r in T.attach_speaker(df, unknown_is_missing=False).collect()][-2] == "unknown"
    paths = {"/a/b.tar/c/d.wav": ["/a/b.tar/c/d.wav", "a/b.tar/c/d.wav", "d.wav", "c/d.wav"], "x.tar::c/d.wav": ["x.tar::c/d.wav", "d.wav", "c/d.wav", ":c/d.wav"], "x.tar:d.wav": ["x.tar:d.wav", "d.wav"], "a\\b.wav": ["a/b.wav", "b.wav"], "": [], None: []}
    assert apply(spark, T.path_candidates, list(paths)) == list(paths.values())
    assert apply(spark, lambda c: T.speaker_from_dir(c, 1), ["/s/x.wav", "x.wav"]) == ["s", "unknown"]
    assert apply(spark, T.suffix, ["a/b.c.wav", ".hid", "x"]) == [".wav", "", ""] and apply(spark, T.stem, ["a/b.c.wav", ".hid"]) == ["b.c", ".hid"]
    m = spark.createDataFrame([("/t.tar/a/1.wav",), ("z/2.wav",), ("none.wav",), ("disk.wav",)], "audio_filepath string")
    index = spark.createDataFrame([("a/1.wav",), ("q/2.wav",), ("b/2.wav",)], "member_name string")
    disk = spark.createDataFrame([("disk.wav",)], "audio_filepath string")
    got = {r.audio_filepath: (r.member, r.origin) for r in corpus.resolve_members(m, index, disk).collect()}
    assert got == {"/t.tar/a/1.wav": ("a/1.wav", "tar"), "z/2.wav": ("b/2.wav", "tar"), "none.wav": (None, None), "disk.wav": (None, "disk")}


def by_rule(ref, hyp):
    n, m = len(ref), len(hyp)
    d = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = d[i - 1][j - 1] if ref[i - 1] == hyp[j - 1] else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    out = []
    while n or m:
        if n and m and ref[n - 1] == hyp[m - 1]:
            out.append(("equal", ref[n - 1], hyp[m - 1])); n -= 1; m -= 1  # noqa: E702
        elif n and m and d[n][m] == d[n - 1][m - 1] + 1:
            out.append(("sub", ref[n - 1], hyp[m - 1])); n -= 1; m -= 1  # noqa: E702
        elif n and d[n][m] == d[n - 1][m] + 1:
            out.append(("del", ref[n - 1], None)); n -= 1  # noqa: E702
        else:
            out.append(("ins", None, hyp[m - 1])); m -= 1  # noqa: E702
    return out[::-1]


def test_alignment(spark):
    rng = random.Random(1)
    cases = [("", ""), ("", "a b"), ("a b", ""), ("a b c", "a b c"), ("a b", "a x"), ("a b", "b a"), (None, "q"), ("q", None)]
    cases += [(" ".join(rng.choices("abcd", k=rng.randint(0, 12))), " ".join(rng.choices("abcd", k=rng.randint(0, 12)))) for _ in range(150)]
    cases += [(" ".join(rng.choices("abc", k=230)), " ".join(rng.choices("abc", k=210)))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, ref string, hyp string")
    want = {i: by_rule((r or "").split(), (h or "").split()) for i, (r, h) in enumerate(cases)}
    count = lambda o, k: sum(x[0] == k for x in o)
    for r in align.align_sdi(df).collect():
        o = want[r.i]
        assert (r.substitutions, r.deletions, r.insertions) == (count(o, "sub"), count(o, "del"), count(o, "ins"))
        assert r.words == count(o, "equal") + r.substitutions + r.deletions and r.errors >= abs(len((r.ref or "").split()) - len((r.hyp or "").split()))
    got = {}
    for r in align.align_ops(df).orderBy("i", "pos").collect():
        got.setdefault(r.i, []).append((r.op, r.ref_word, r.hyp_word))
    assert got == {i: o for i, o in want.items() if o}
    d = df.select("i", align.word_edit_distance(T.words(F.col("ref")), T.words(F.col("hyp"))).alias("d")).collect()
    assert all(r.d == sum(x[0] != "equal" for x in want[r.i]) for r in d)
    m = spark.createDataFrame([("k", "a b")], "audio string, ref string")
    e = align.edit_counts(m, spark.createDataFrame([], "audio string, hyp string"), ["audio"]).first()
    assert e.deletions == 2 and e.failed
    w = spark.createDataFrame([(0, 0), (1, 2)], "e int, n int").select(align.utterance_wer(F.col("e"), F.col("n")).alias("w")).collect()
    assert [r.w for r in w] == [float("inf"), 0.5]


def test_whole_texts(spark, tmp_path, monkeypatch):
    """Pairs far beyond forty words and beyond the letter pool, against the plain rule."""
    rng = random.Random(2)
    many = " ".join(f"w{i}" for i in range(2_100))
    cases = [(many, many.replace("w7 ", "").replace("w2000", "zz")), (many, ""), ("", many)]
    cases += [(" ".join(rng.choices("abcdefgh", k=rng.randint(30, 400))), " ".join(rng.choices("abcdefgh", k=rng.randint(30, 400)))) for _ in range(12)]
    for r, h in cases[3:]:
        want = by_rule(r.split(), h.split())
        for cells in (1 << 26, 1):  # in one run, and in runs that are made again
            monkeypatch.setattr(align, "_RUN_CELLS", cells)
            assert align._align(r.split(), h.split()) == "".join({"equal": "E", "sub": "S", "del": "D", "ins": "I"}[x[0]] for x in want)
        assert align._distance(r.split(), h.split()) == sum(x[0] != "equal" for x in want)
    df = spark.createDataFrame(cases[:3], "ref string, hyp string")
    assert [r.d for r in df.select(align.word_edit_distance(T.words(F.col("ref")), T.words(F.col("hyp"))).alias("d")).collect()] == [2, 2_100, 2_100]
    text = " ".join(rng.choices("abcdefgh", k=90))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, t, "user", text) for t in (0, 1)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.words for r in catalog.align_sdi(spark, str(tmp_path)).collect()} == {90}
    assert catalog.align_ops(spark, str(tmp_path)).count() == 90
    assert {(r.model, r.words) for r in catalog.model_sdi_summary(spark, str(tmp_path)).collect()} == {(m, 90) for m in catalog.B.MODELS}


def test_row_bootstrap_draws_all_replicates(spark, sf, monkeypatch):
    taken = []
    whole = routing.jsd_bootstrap
    monkeypatch.setattr(routing, "jsd_bootstrap", lambda df, keys, replicates, **k: taken.append(replicates) or whole(df, keys, replicates, **k))
    catalog.jsd_bootstrap_rows(spark, sf)
    assert taken == [1_000]


def test_short_pairs_together():
    """Pairs around the bounds of the kernel for short pairs, against the plain rule."""
    rng = random.Random(7)
    sides = [(0, 0), (0, 5), (5, 0), (1, 64), (64, 1), (64, 64), (65, 65), (256, 64), (257, 64), (40, 40), (3, 63), (256, 3)]
    pairs = [(rng.choices("abcde", k=n), rng.choices("abcde", k=m)) for n, m in sides for _ in range(3)]
    import pyarrow as pa

    kind = pa.list_(pa.string())
    p = align._Pairs(pa.array([r for r, _ in pairs] + [None], kind), pa.array([h for _, h in pairs] + [["q"]], kind))
    short = {"equal": "E", "sub": "S", "del": "D", "ins": "I"}
    want = ["".join(short[x[0]] for x in by_rule(r, h)) for r, h in pairs] + ["I"]
    assert [o.decode() for o in p.ops()] == want
    assert p.distances().tolist() == [sum(x != "E" for x in w) for w in want]


def test_very_long_pair(spark):
    """Twenty thousand words on either side."""
    said = [f"w{i % 3_000}" for i in range(20_000)]
    heard = [w for i, w in enumerate(said) if i % 1_000 != 7]
    df = spark.createDataFrame([(" ".join(said), " ".join(heard))], "ref string, hyp string")
    r = align.align_sdi(df).select("words", "substitutions", "deletions", "insertions").first()
    assert tuple(r) == (20_000, 0, 20, 0)


def test_pair_of_two_hundred_thousand_words():
    """Many different words on either side: bits are kept for some of them only, and memory stays bounded."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    said = [i * 7919 % 60_000 for i in range(200_000)]
    heard = [w if i % 2_000 != 7 else -1 for i, w in enumerate(said) if i % 5_000 != 9]
    assert align._distance(said, heard) == 200_000 // 5_000 + 200_000 // 2_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes
    rng = random.Random(8)
    ref, hyp = rng.choices("abcdefghijkl", k=300), rng.choices("abcdefghijkl", k=280)
    few, all_ = align._Places(hyp, 1), align._Places(hyp)
    assert len(few.kept) == 1 and all(few.get(w) == all_.get(w) for w in "abcdefghijklz")


def test_places(spark, monkeypatch):
    """Places and quantiles over ranges against sorting, with ties, nulls and groups of a single row."""
    from vocalith.operators import ranks

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([1.0, 2.0, 7.5, rng.random() * 9])) for _ in range(500)] + [("c", 1.0)]
    for edges in (256, 3):
        monkeypatch.setattr(ranks, "VALUE_RANGES", edges)
        got = ranks.numbered_by_value(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
        for g in {g for g, _ in rows}:
            mine = sorted((r._i, r.v) for r in got if r.g == g)
            assert [i for i, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for k, v in rows if k == g) and all(r._n == len(mine) for r in got if r.g == g)
        values = sorted(v for _, v in rows)
        for r in ranks.quantiles(spark.createDataFrame([*rows, ("a", None)], "g string, v double"), "v", [0.0, 0.1, 1 / 3, 0.5, 0.97, 1.0]).collect():
            at = r.share * (len(values) - 1)
            lo, hi = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert abs(r.quantile - (lo + (hi - lo) * (at - int(at)))) < 1e-9
        assert ranks.quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.5]).first().quantile == 3.0
        assert ranks.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0
    names = [("g", f"s{i}") for i in range(300)]
    placed = ranks.numbered_by_hash(spark.createDataFrame(names, "g string, s string"), ["g"], F.col("s")).collect()
    assert sorted(r.ix for r in placed) == list(range(300)) and {r.n for r in placed} == {300}


def test_row_bootstrap_draws_from_all_rows(spark):
    """A replicate draws from all rows of a side, so that a layer of few rows is missing from some replicates."""
    rows = [("m", s, f"{s}{u}", layer, 1.0, [0.5, 0.5]) for s in ("adult", "child") for u in range(6) for layer in ((0, 1) if u == 0 else (0,))]
    df = spark.createDataFrame(rows, "model string, age_group string, utterance_id string, layer_idx int, duration_sec double, probs array<double>")
    n = {r.layer_idx: r["count"] for r in routing.jsd_bootstrap(df, ["model"], 60, unit="row").where("jsd is not null").groupBy("layer_idx").count().collect()}
    assert n[0] == 60 and 0 < n[1] < 60


def test_hypotheses_in_several_maps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "MAP_ROWS", 7)
    rows = [("m_1", "set", f"/a/{i}.wav", 'x "y"\n' if i % 3 else "") for i in range(40)] + [("m2", "other", "b", None)]
    io.write_hypotheses(spark.createDataFrame(rows, "model string, test_set string, audio_filepath string, hyp string"), str(tmp_path / "h"))
    assert sorted(map(tuple, io.read_hypotheses(spark, str(tmp_path / "h")).collect())) == sorted((*r[:3], r[3] or "") for r in rows)


def test_confusion_matrix_keeps_unknown_predictions(spark):
    c = spark.createDataFrame([("a", "a", 3), ("a", "zz", 2), ("a", "qq", 1), ("x", "a", 9)], "word string, pred string, n long")
    assert sorted(map(tuple, score.confusion_matrix(c, ["a", "b"]).collect())) == [("a", "a", 3), ("a", "b", 0), ("a", "qq", 1), ("a", "zz", 2), ("b", "a", 0), ("b", "b", 0)]


#: Published adult WER, child WER and bias in percent.
PUBLISHED = [
    (2.98, 26.99, 24.01), (2.56, 24.16, 21.60), (2.94, 14.65, 11.71), (2.62, 14.08, 11.46), (2.66, 14.05, 11.39), (3.14, 26.67, 23.53), (2.71, 81.38, 78.67), (6.64, 67.72, 61.08),
    (7.52, 118.32, 110.80), (3.49, 29.08, 25.60), (2.78, 89.59, 86.81), (6.12, 69.50, 63.38), (7.22, 128.77, 121.55), (3.54, 16.05, 12.51), (3.51, 22.59, 19.08), (8.00, 37.99, 29.99),
    (8.36, 99.66, 91.30), (3.37, 14.50, 11.13), (2.72, 20.54, 17.82), (7.00, 48.86, 41.87), (7.14, 96.06, 88.92), (3.44, 14.50, 11.06), (2.72, 20.91, 18.19), (7.10, 49.34, 42.24), (7.20, 101.03, 93.83),
]


def test_bias(spark):
    rows = [(str(i), a, 10000, round(x * 100)) for i, (ad, ch, _) in enumerate(PUBLISHED) for a, x in (("adult", ad), ("child", ch))]
    e = spark.createDataFrame(rows + [("one", "adult", 5, 1), ("none", "child", 0, 1), ("none", "adult", 4, 0)], "model string, age_group string, words int, errors int")
    got = {r.model: r.bias for r in score.absolute_bias(e, ["model"]).collect()}
    assert all(abs(got[str(i)] - b) <= 0.011 for i, (_, _, b) in enumerate(PUBLISHED)) and got["one"] is None and got["none"] is None
    models = spark.createDataFrame([("0", "dense", "pretrained"), ("2", "dense", "finetuned"), ("3", "sparse", "finetuned")], "model string, arch string, stage string")
    d = {r.model: r.bias_delta for r in score.bias_delta(score.absolute_bias(e, ["model"]), models).collect()}
    assert abs(d["2"] + 12.3) < 0.011 and d["3"] is None


def test_model_alignment_fails_loudly(spark):
    good = [("a", 1, 3, 1), ("b", 1, 3, 2)]
    df = lambda rows: spark.createDataFrame(rows, "model string, k int, words int, errors int")
    assert score.align_models(df(good), "a", "b", ["k"]).first().errors_b == 2
    for bad in ([*good, ("a", 2, 1, 1)], [good[0], ("b", 1, 4, 0)], [*good, good[0]]):
        with pytest.raises(Exception, match="do not meet once"):
            score.align_models(df(bad), "a", "b", ["k"]).collect()
    m, h = spark.createDataFrame([(1, "a b")], "k int, ref string"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, hyp string")
    with pytest.raises(Exception, match="several hypotheses"):
        align.attach_hypotheses(m, h, ["k"]).collect()


def test_fdr(spark):
    def adjusted(ps):
        df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, i int, p double")
        return [(round(r.p_adj, 6), r.significant) for r in stats.fdr_over_family(df, ["f"]).orderBy("i").collect()]

    assert adjusted([0.01, 0.02, 0.03, 0.04]) == [(0.04, True)] * 4
    assert adjusted([0.04, 0.001, 0.5]) == [(0.06, False), (0.003, True), (0.5, False)]
    assert adjusted([0.02, 0.02]) == [(0.02, True)] * 2 and adjusted([1.0, 1.0]) == [(1.0, False)] * 2 and adjusted([0.03]) == [(0.03, True)] and adjusted([]) == []


def test_bootstrap(spark):
    u = spark.createDataFrame([("g", f"s{i}", i % 3, (i * 7) % 5, 10) for i in range(12)], "g string, speaker string, errors_a long, errors_b long, words long")
    a = [tuple(r) for r in stats.paired_bootstrap(u, ["g"], 50, 3).orderBy("replicate").collect()]
    assert a == [tuple(r) for r in stats.paired_bootstrap(u.repartition(7), ["g"], 50, 3).orderBy("replicate").collect()] and len(a) == 50
    same = u.withColumn("errors_b", F.col("errors_a"))
    r = stats.compare_models(same, ["g"], 50, 3).first()
    assert (r.diff, r.ci_low, r.ci_high, r.p, r.n_units) == (0, 0, 0, 0, 12)


def test_verdicts(spark):
    rows = [("negative", True, -2.0, -1.0, "lower"), ("negative", True, 1.0, 2.0, "higher"), ("either", True, -2.0, -1.0, "on_lower"), ("either", True, 1.0, 2.0, "on_higher"), ("negative", False, -2.0, -1.0, "none"), ("either", True, -1.0, 1.0, "none")]
    df = spark.createDataFrame(rows, "direction string, significant boolean, ci_low double, ci_high double, want string")
    assert all(r.decision == stats.VERDICTS[r.want] for r in stats.decide(df).collect())
    assert all(r.decision == stats.PAIRED_VERDICTS[r.want] for r in stats.decide(df, stats.PAIRED_VERDICTS).collect())
    gaps = spark.createDataFrame([(True, -3.0, -1.0, -2.0), (True, 1.0, 3.0, 2.0), (False, -1.0, 1.0, -0.5)], "significant boolean, ci_low double, ci_high double, gap_delta double")
    assert [("reduces" in r.decision, "increases" in r.decision, "smaller" in r.decision) for r in stats.decide_gap(gaps).collect()] == [(True, False, False), (False, True, False), (False, False, True)]


def test_distributions(spark):
    rows = [("adult", 0, 1.0, [1.0, 0.0]), ("child", 0, 2.0, [0.0, 1.0]), ("adult", 1, 1.0, [0.5, 0.5]), ("child", 1, 1.0, [0.5, 0.5]), ("adult", 2, 1.0, [1.0, 0.0]), ("adult", 3, 0.0, [1.0, 0.0]), ("child", 3, 1.0, [1.0, 0.0]), ("child", 1, float("nan"), [0.0, 1.0]), ("child", 1, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "age_group string, layer_idx int, duration_sec double, probs array<double>")
    d = routing.weighted_distribution(df, ["layer_idx", "age_group"])
    got = {r.layer_idx: r.jsd for r in routing.jsd_between(d, ["layer_idx"], "age_group", "adult", "child").collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None, 3: None}
    p = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.4, 0.4, 0.2],)], "p array<double>").select(routing.top1(F.col("p")).alias("a"), routing.top2(F.col("p")).alias("b")).collect()
    assert [(r.a, r.b) for r in p] == [(1, 2), (0, 1)]


def test_duration_cap(spark):
    rows = [("a", f"u{i}", layer, 10.0) for i in range(200) for layer in (0, 1)] + [("b", "v0", 0, 500.0), ("b", "v1", 0, 500.0), ("c", "w", 0, 1.0), ("c", "x", 0, None)]
    df = spark.createDataFrame(rows, "g string, utterance_id string, layer_idx int, duration_sec double")
    got = routing.duration_cap(df, ["g"], 95.0)
    n = {r.g: (r.u, r.n) for r in got.groupBy("g").agg(F.countDistinct("utterance_id").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"a": (10, 20), "b": (1, 1), "c": (1, 1)}
    order = [r.utterance_id for r in df.where("g = 'a' and layer_idx = 0").orderBy(routing.hash_order(1)).collect()][:10]
    assert {r.utterance_id for r in got.where("g = 'a'").collect()} == set(order)


def test_linspace(spark):
    for n in (1, 5, 7, 100, 101, 333):
        df = spark.createDataFrame([("g", i) for i in range(n)], "g string, i int")
        for most in (1, 2, 7, 100):
            want = set(range(n)) if n <= most and most > 1 else {k * (n - 1) // (most - 1) for k in range(most)} if most > 1 else {0}
            assert {r.i for r in routing.linspace_subsample(df, ["g"], "i", most).collect()} == want, (n, most)


def test_exposure(spark):
    s = spark.createDataFrame([("pl", 125.0, None), ("nl", 88.0, 1.0), ("de", 1206.0, 1.0), ("en", 460.0, 1.0)], "source string, hours double, weight double")
    got = {r.source: (r.repeats, r.unseen_hours) for r in corpus.exposure_plan(s).collect()}
    assert round(got["pl"][0], 1) == 3.8 and round(got["nl"][0], 1) == 5.3 and round(got["de"][0], 2) == 0.39 and round(got["en"][0], 1) == 1.0 and round(got["de"][1]) == 736


def test_corpus_jobs(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", 5000 + i) for i in range(100)], "source string, id int")
    shares = corpus.mixture_weights(spark.createDataFrame([("a", 1.0), ("b", None)], "source string, weight double"))
    n = {r.source: r["count"] for r in corpus.mixture_sample(rows, shares, 1000, "id").groupBy("source").count().collect()}
    assert n == {"a": 500, "b": 500}
    shares = spark.createDataFrame([("a", 0.61), ("b", 0.28), ("gone", 0.11)], "source string, share double")
    for size in (1, 7, 999, 12_345):
        got = corpus.mixture_sample(rows, shares, size, "id").groupBy("source", "id").count().collect()
        assert sum(r["count"] for r in got) == size and all(max(c) - min(c) <= 1 for s in "ab" for c in [[r["count"] for r in got if r.source == s] or [0]])
    s = corpus.speaker_split(spark.createDataFrame([(f"s{i % 300}",) for i in range(900)], "speaker string"))
    assert s.groupBy("speaker").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    clean = {"hel- lo [noise] (x) <y>": "hel lo", "ok*": "ok", "a uh b": "a b"}
    assert apply(spark, lambda c: corpus.clean_transcription(c, ("uh",)), clean) == list(clean.values())
    packed = corpus.pack_short_clips(spark.createDataFrame([("s", f"p{i}", 4.0, f"t{i}") for i in range(5)], "speaker string, audio_filepath string, duration double, text string"), 10.0).orderBy("pack").collect()
    assert [(r.clips, r.text) for r in packed] == [(3, "t0 t1 t2"), (2, "t3 t4")]


def test_sources(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"audio_filepath": "a", "duration": 1.5, "text": "x"}\n\n{"audio_filepath": "b", "duration_sec": 2}\n{"audio_filepath": "c"}\n')
    assert [r.audio_filepath for r in io.read_manifest(spark, str(p)).orderBy("audio_filepath").collect()] == ["a", "b", "c"]
    assert [r.audio_filepath for r in io.read_manifest_head(spark, str(p), 2).collect()] == ["a", "b"] and io.read_manifest_head(spark, str(p), -1).count() == 3
    d = {r.audio_filepath: r.duration_sec for r in corpus.coalesce_duration(io.read_manifest(spark, str(p))).collect()}
    assert d == {"a": 1.5, "b": 2.0, "c": None}
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        io.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "hyp__m_1__set.json").write_text('{"a": "x y", "b": ""}')
    assert sorted(map(tuple, io.read_hypotheses(spark, str(tmp_path / "hyp__*.json")).collect())) == [("m_1", "set", "a", "x y"), ("m_1", "set", "b", "")]
    wide = spark.createDataFrame([("u", "adult", 0, 1.0, *map(float, range(11)))], ["utterance_id", "age_group", "layer_idx", "duration_sec", *[f"expert_{i}_prob" for i in range(11)]])
    assert io.routing_from_wide(wide).first().probs == list(map(float, range(11)))
    for bad in (wide.drop("age_group"), wide.select("utterance_id", "age_group", "layer_idx", "duration_sec")):
        with pytest.raises(ValueError):
            io.routing_from_wide(bad)
    with pytest.raises(ValueError):
        io.routing_from_wide(wide, experts=8)
    dup = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 5, "c")], "k string, o int, x string")
    assert sorted((r.k, r.x) for r in io.distinct_utterances(dup, "k", "o").collect()) == [("u", "a"), ("v", "c")]


def test_sdi_queries_agree_with_distances(spark, sf):
    key = lambda r: (r.model, r.doc_id, r.seg)
    sdi = {key(r): r.substitutions + r.deletions + r.insertions for r in catalog.QUERIES["utterance_sdi"](spark, sf).collect()}
    plain = {key(r): r.errors for r in catalog.QUERIES["edit_counts"](spark, sf).collect()}
    assert sdi == plain
    # Whole recordings: no word is left out, and their distances are those that a plain edit distance of words gives.
    whole = {(r.model, r.doc_id): r for r in catalog.QUERIES["align_sdi"](spark, sf).collect()}
    n_words = {}
    for r in catalog.QUERIES["edit_counts"](spark, sf).collect():
        n_words[r.model, r.doc_id] = n_words.get((r.model, r.doc_id), 0) + r.words
    assert {k: r.words for k, r in whole.items()} == n_words
    for k, r in sorted(whole.items())[:60]:
        if r.words <= 400:
            assert r.errors == sum(x[0] != "equal" for x in by_rule(r.ref.split(), r.hyp.split()))
    shares = catalog.QUERIES["speaker_breakdown"](spark, sf).collect()
    assert all(abs(r.substitutions_share + r.deletions_share + r.insertions_share - 1) < 1e-9 or r.wer == 0 for r in shares)
    words = catalog.QUERIES["word_error_counts"](spark, sf).collect()
    assert {r.word for r in words if r.op == "ins"} <= {"zz"} | {r.word for r in words} and all(r["rank"] <= 20 for r in words)
    assert all(re.search(r"pp \(95% CI", r.summary) for r in catalog.QUERIES["decision_sentences"](spark, sf).collect())
    assert all(0 <= r.ci_low <= r.ci_high <= 1 for r in catalog.QUERIES["jsd_bootstrap_rows"](spark, sf).collect())
