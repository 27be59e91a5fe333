"""Shared steps of the queries that grew too fast: what they hand on, and how much of it meets in one task."""

from pyspark.sql import functions as F

from vocalith.operators import align
from vocalith.plans import base as B


def _pairs(spark):
    rows = [(0, "a b c d", "a x c"), (1, "", "a"), (2, "a a b", "a a b"), (3, None, None), (4, "b " * 300, "b c " * 100)]
    return spark.createDataFrame(rows, "i int, ref string, hyp string").withColumns({"rw": F.split("ref", r" +"), "hw": F.split("hyp", r" +")}).withColumns({c: F.array_remove(c, "") for c in ("rw", "hw")})


def test_words_are_aligned_as_they_are(spark):
    p = _pairs(spark)
    columns = ["i", "words", "substitutions", "deletions", "insertions", "errors"]
    texts = align.align_sdi(p.select("i", "ref", "hyp")).select(columns).collect()
    assert sorted(align.align_sdi(p.select("i", "rw", "hw"), "rw", "hw").select(columns).collect()) == sorted(texts)


def test_errors_are_the_ops_that_are_not_equal(spark, monkeypatch):
    p = _pairs(spark)
    ops = align.align_ops(p.select("i", "ref", "hyp")).where("op <> 'equal'").select("i", "op", "ref_word", "hyp_word").collect()
    got = align.align_errors(p.select("i", "rw", "hw"), "rw", "hw")
    assert got.columns == ["i", "op", "ref_word", "hyp_word"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got.collect(), key=key) == sorted(ops, key=key) and len(ops) > 200


def test_lists_do_not_follow_how_many_pairs_are_taken_at_a_time(monkeypatch):
    import pyarrow as pa

    ref = pa.array([["a", "b"], None, ["c"] * 9, [], ["d", "e", "f"]] * 3, pa.list_(pa.string()))
    hyp = pa.array([["a"], ["x"], ["c"] * 4, None, ["d", "q", "f"]] * 3, pa.list_(pa.string()))
    for wrong in (False, True):
        whole = align._lists(ref, hyp, wrong).to_pylist()
        monkeypatch.setattr(align, "LISTED", 5)
        assert align._lists(ref, hyp, wrong).to_pylist() == whole
        monkeypatch.undo()


def test_utterance_hypotheses_are_those_of_the_rule(spark):
    u = spark.range(B.UTTERANCE_WORDS + 1).select(F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: i.cast("string")).alias("w")).select(F.slice("w", 2, 100).alias("w"))
    for x in B.MODELS.values():
        assert u.where(B.corrupted_utterance(F.col("w"), *x) != B.corrupted(F.col("w"), *x)).count() == 0


def test_reference_is_aligned_with_all_models_beside_one_copy(spark, sf):
    plan = B.edits(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan.split("ArrowEvalPython")[0].split("Generate inline")[0] and plan.count("ArrowEvalPython") >= 1
    lines = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
    assert all(x.count("_word_distance(") == len(B.MODELS) for x in lines)


def test_a_large_file_is_dealt_over_more_tasks_than_cores(spark, sf, monkeypatch):
    d = B.table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    assert B.spread(d).rdd.getNumPartitions() == cores
    monkeypatch.setattr(B, "SPREAD_BYTES", 4096)
    assert B.spread(d).rdd.getNumPartitions() > 2 * cores


def test_confusions_are_counted_once(spark, sf):
    from vocalith.plans import catalog

    plan = catalog.most_mistaken(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "benchmark.parquet" not in plan


def test_hypotheses_are_not_dealt_by_the_name_of_their_map(spark, tmp_path):
    from vocalith.sources import io

    hyps = spark.createDataFrame([("m", "s", f"{i}.wav", f"h {i}") for i in range(50)], "model string, test_set string, audio_filepath string, hyp string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in io.hypothesis_maps(hyps)._jdf.queryExecution().executedPlan().toString()
        io.write_hypotheses(hyps, str(tmp_path / "h"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.audio_filepath, r.hyp) for r in io.read_hypotheses(spark, str(tmp_path / "h")).collect()} == {(f"{i}.wav", f"h {i}") for i in range(50)}


def test_parts_of_a_table_are_written_without_a_sort(spark, tmp_path):
    from vocalith.sources import io

    rows = spark.range(1000).selectExpr("id", "cast(id % 3 as string) AS model")
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    io.write_table(rows, str(tmp_path / "t"), ["model"], keep=True)
    io.write_table(rows.where("false"), str(tmp_path / "t"), ["model"], keep=True)
    assert spark.conf.get(name) == before and io.WRITERS >= len(B.MODELS)
    assert {(r.id, str(r.model)) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(i, str(i % 3)) for i in range(1000)}


def test_pairs_of_words_are_dealt_once_and_first_predictions_before_they_meet(spark):
    from collections import Counter

    from vocalith.operators import score

    texts = [("m", ["the", "cat", "the", "dog", "the", "cat"]), (None, ["the", "the"]), ("m", []), (None, None), ("n", ["hot"] * 50 + [f"w{i % 7}" for i in range(40)])]
    pairs = score.next_word_pairs(spark.createDataFrame(texts, "model string, words array<string>"), ["model"])
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    dictionary = spark.createDataFrame([("the", "th"), ("th", "th"), ("cat", "ca"), ("hot", "w1")], "token string, canonical string")
    form = lambda w: {"the": "th", "cat": "ca", "hot": "w1"}.get(w, w)
    said: dict = {}
    for model, w in texts:
        w = w or [""]
        for a, b in zip(w, [*w[1:], ""]):
            said.setdefault((model, form(a)), Counter())[b] += 1
    for strict in (False, True):
        out = score.word_accuracy(pairs, dictionary, ["model"], strict=strict, top=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "_part" not in plan
        got = {(r.model, r.word): (r.total, r.correct, r.top_preds) for r in out.collect()}
        want = {}
        for (model, word), c in said.items():
            right = sum(n for h, n in c.items() if form(h) == word and (not strict or word in ("th", "ca", "w1")))
            want[model, word] = (sum(c.values()), right, ";".join(f"{h}:{n}" for h, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:2]))
        assert got == want
        bare = score.word_accuracy(pairs, dictionary, ["model"], strict=strict, top=0)
        assert {(r.model, r.word): (r.total, r.correct) for r in bare.collect()} == {k: v[:2] for k, v in want.items()} and "top_preds" not in bare.columns


def test_the_range_of_a_value_is_found_without_a_walk_over_all_edges(spark, monkeypatch):
    from vocalith.operators import ranks

    edges, values = [-2.0, -1.0, -1.0, 0.0, 0.5, 0.5, 0.5, 3.0, 9.0], [None, -9.0, -2.0, -1.5, -1.0, -0.0, 0.0, 0.2, 0.5, 0.7, 3.0, 8.0, 9.0, 10.0, float("nan")]
    df = spark.createDataFrame([(v, edges[:n]) for v in values for n in range(10)], "v double, _e array<double>")
    for ranges in (10, 16, 17, 256):
        monkeypatch.setattr(ranks, "VALUE_RANGES", ranges)
        found = ranks.below(df, "v", "_r")
        assert found.where(F.size(F.filter("_e", lambda e: e < F.col("v"))) != F.col("_r")).count() == 0 and found.count() == 150
    monkeypatch.undo()
    rows = spark.range(1000).selectExpr("id", "cast(id % 3 as string) AS g", "cast(id % 40 as double) AS v")
    for out in (ranks.numbered_by_value(rows, ["g"], "v"), ranks.value_ranges(rows, ["g"], "v"), ranks.quantiles(rows, "v", [0.5])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "lambdafunction" not in plan and "array_contains" not in plan


def test_ops_are_listed_once_and_leave_in_pieces(spark, sf, monkeypatch):
    import pyarrow as pa

    from vocalith.plans import catalog

    for out in (catalog.align_ops(spark, sf), catalog.word_error_counts(spark, sf)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("ArrowEvalPython [" in line for line in plan.splitlines()) == 1
    monkeypatch.setattr(align, "LISTED", 5)
    ref = pa.array([["a", "b"], None, ["c"] * 9, [], ["d"]] * 20, pa.list_(pa.string()))
    pieces = list(align._pieces(ref, ref, False))
    assert len(pieces) > 20 and sum(map(len, pieces)) == len(ref) and max(len(x.flatten()) for x in pieces) <= 12
