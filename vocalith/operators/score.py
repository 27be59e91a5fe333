"""Transcript scoring: corpus, speaker and word level (G1-G14, G22, G24, G26, G27) and its joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.text import canonical_word, first_word
from vocalith.operators.ranks import beside
from vocalith.sources.scratch import stored

INF = float("inf")


def ratio(errors: Column, n: Column) -> Column:
    return F.when(n > 0, errors / n).otherwise(F.lit(INF))


def corpus_wer(edits: DataFrame, keys: list[str]) -> DataFrame:
    """G1: micro WER per key: all errors over all words."""
    sums = edits.groupBy(*keys).agg(F.count(F.lit(1)).alias("utterances"), F.sum("words").alias("words"), F.sum("errors").alias("errors"))
    return sums.withColumn("wer", ratio(F.col("errors"), F.col("words")))


def overall_wer(edits: DataFrame, key: str) -> DataFrame:
    """corpus_wer by key and one row OVERALL over the keys that have words."""
    per = edits.groupBy(key).agg(F.count(F.lit(1)).alias("utterances"), F.sum("words").alias("words"), F.sum("errors").alias("errors"))
    total = per.where("words > 0").agg(F.lit("OVERALL").alias(key), F.sum("utterances").alias("utterances"), F.sum("words").alias("words"), F.sum("errors").alias("errors"))
    return per.unionByName(total).withColumn("wer", ratio(F.col("errors"), F.col("words")))


def _side(age: str, what: str) -> Column:
    return F.sum(F.when(F.col("age_group") == age, F.col(what)))


def absolute_bias(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Child WER minus adult WER in percentage points per key; null when a side has no words."""
    sums = edits.groupBy(*keys).agg(*[_side(a, w).alias(f"{a}_{w}") for a in ("adult", "child") for w in ("errors", "words")])
    pct = lambda a: F.when(F.col(f"{a}_words") > 0, 100 * F.col(f"{a}_errors") / F.col(f"{a}_words"))
    return sums.select(*keys, pct("adult").alias("adult_wer"), pct("child").alias("child_wer"), (pct("child") - pct("adult")).alias("bias"))


def bias_delta(bias: DataFrame, models: DataFrame) -> DataFrame:
    """Bias of each fine-tuned model minus that of the pretrained model of its architecture (models: model, arch, stage)."""
    named = bias.join(models, "model")
    base = named.where("stage = 'pretrained'").select("arch", F.col("bias").alias("pretrained_bias"))
    return named.where("stage <> 'pretrained'").join(base, "arch", "left").select("model", "arch", "bias", "pretrained_bias", (F.col("bias") - F.col("pretrained_bias")).alias("bias_delta"))


_SDI = ["substitutions", "deletions", "insertions", "words"]


def sdi_summary(edits: DataFrame, keys: list[str]) -> DataFrame:
    """S, D, I, words, utterances and WER per key (model and speaker, or model and set)."""
    sums = edits.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SDI], F.count(F.lit(1)).alias("utterances"))
    return sums.withColumn("wer", ratio(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("words")))


def error_type_share(summary: DataFrame) -> DataFrame:
    """Each error type as a share of all errors; without errors all shares are 0."""
    total = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    by = F.when(total == 0, 1).otherwise(total)
    return summary.withColumns({f"{c}_share": F.col(c) / by for c in _SDI[:3]})


def word_error_counts(ops: DataFrame, keys: list[str]) -> DataFrame:
    """How often each word was substituted, deleted or inserted."""
    word = F.when(F.col("op") == "ins", F.col("hyp_word")).otherwise(F.col("ref_word"))
    return ops.where("op <> 'equal'").groupBy(*keys, "op", word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


def substitution_pairs(ops: DataFrame, keys: list[str]) -> DataFrame:
    """(ref_word, hyp_word) substitutions and their counts."""
    return ops.where("op = 'sub'").groupBy(*keys, "ref_word", "hyp_word").agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in an order that the caller makes total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def head_to_head(edits: DataFrame, models: list[str], key: str = "audio_filepath") -> DataFrame:
    """Utterances that all the models scored, one WER column per model, in one pass over the edit table."""
    wer = ratio(F.col("errors"), F.col("words"))
    return edits.where(F.col("model").isin(models)).groupBy(key).pivot("model", models).agg(F.first(wer)).dropna(subset=models)


def win_bucket(table: DataFrame, dense: str, moe: list[str]) -> DataFrame:
    """Who has the lowest WER per utterance: the dense model alone, a sparse one alone, or both."""
    best = F.least(*moe) if len(moe) > 1 else F.col(moe[0])
    return table.withColumn("bucket", F.when(F.col(dense) < best, "dense_wins").when(best < F.col(dense), "moe_wins").otherwise("tie_dense_moe"))


def win_counts(table: DataFrame, models: list[str]) -> DataFrame:
    return table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in models])


def first_word_pairs(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(keys, ref, hyp, n): how often two first words meet."""
    firsts = pairs.select(*keys, first_word(F.col(ref)).alias("ref"), first_word(F.col(hyp)).alias("hyp"))
    return firsts.groupBy(*keys, "ref", "hyp").agg(F.count(F.lit(1)).alias("n"))


def next_word_pairs(texts: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, ref, hyp, n): each word of an array and the one behind it, '' behind the last; an empty array is '' followed by ''. A row per place, n is 1; who takes them adds them up."""
    w = F.when(F.size(words) > 0, F.col(words)).otherwise(F.array(F.lit("")))
    both = F.arrays_zip(w.alias("ref"), F.slice(w, 2, F.size(w)).alias("hyp"))
    return texts.select(*keys, F.inline(both)).select(*keys, "ref", F.coalesce("hyp", F.lit("")).alias("hyp"), F.lit(1).cast("long").alias("n"))


#: Parts into which the predictions of a word are dealt, so that a hot word is no task of its own.
PARTS = 64


def best_predictions(counts: DataFrame, keys: list[str], pred: str, n: str, k: int, name: str) -> DataFrame:
    """(keys, name): the k predictions with the largest n, the first in order on ties, as 'pred:n;...'.

    Each part of a word's predictions keeps its k best, and the k best of all are among them.
    """
    best = lambda some: F.slice(F.sort_array(some), 1, k)
    each = counts.select(*keys, F.pmod(F.xxhash64(pred), F.lit(PARTS)).alias("_part"), F.struct((-F.col(n)).alias("n"), F.col(pred).alias("p")).alias("_s"))
    parts = each.groupBy(*keys, "_part").agg(best(F.collect_list("_s")).alias("_s"))
    merged = parts.groupBy(*keys).agg(best(F.flatten(F.collect_list("_s"))).alias("_s"))  # at most PARTS * k entries
    return merged.select(*keys, F.array_join(F.transform("_s", lambda x: F.concat_ws(":", x["p"], (-x["n"]).cast("string"))), ";").alias(name))


def word_confusion(counts: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """Counted pairs (ref, hyp, n) of words on canonical forms: (keys, word, pred, n, total). The counts are stored, as totals and callers read them again."""
    both = canonical_word(canonical_word(counts, "ref", dictionary, "word"), "hyp", dictionary, "pred")
    n = stored(both.groupBy(*keys, "word", "pred").agg(F.sum("n").alias("n")), "confusion")
    return beside(n, n.groupBy(*keys, "word").agg(F.sum("n").alias("total")), [*keys, "word"])


def most_mistaken(confusion: DataFrame, keys: list[str], k: int = 15, top: int = 3) -> DataFrame:
    """Per key the k words with most errors, and as mistaken_for 'pred:count;...' the wrong words they were taken for most."""
    wrong = F.when(F.col("pred") != F.col("word"), F.col("n")).otherwise(0)
    rows = confusion.groupBy(*keys, "word").agg(F.max("total").alias("total"), F.sum(wrong).alias("errors"))
    worst = top_k(rows, keys, [F.desc("errors"), F.asc("word")], k)
    taken = beside(confusion.where("pred <> word"), worst.select(*keys, "word").withColumn("_worst", F.lit(True)), [*keys, "word"])
    best = best_predictions(taken, [*keys, "word"], "pred", "n", top, "mistaken_for")
    return beside(worst, best, [*keys, "word"], how="left").withColumn("mistaken_for", F.coalesce("mistaken_for", F.lit("")))


def word_accuracy(counts: DataFrame, dictionary: DataFrame, keys: list[str], strict: bool = False, top: int = 3) -> DataFrame:
    """Counted pairs (ref, hyp, n), each any number of times: per key and canonical word total, correct, accuracy, and the top predictions as 'word:count;...' (none with top 0).

    A prediction is correct when its canonical form is the word's; with strict, words without a dictionary entry are
    never correct.
    """
    # Words take their canonical form before they are counted, predictions after, so pairs are dealt once.
    n = canonical_word(counts, "ref", dictionary, "word").groupBy(*keys, "word", "hyp").agg(F.sum("n").alias("n"))
    both, ok = canonical_word(n, "hyp", dictionary, "_p"), F.col("_p") == F.col("word")
    if strict:
        known = dictionary.select(F.col("canonical").alias("word")).distinct().withColumn("_known", F.lit(True))
        both, ok = both.join(known, "word", "left"), ok & F.col("_known").isNotNull()
    out = both.groupBy(*keys, "word").agg(F.sum("n").alias("total"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("correct"))
    out = out.withColumn("accuracy", F.col("correct") / F.col("total"))
    if not top:
        return out
    # Each task hands on its first rows of a word only, so a hot word is no task of its own.
    first = top_k(n, [*keys, "word"], [F.desc("n"), F.asc("hyp")], top)
    said = F.struct("rank", F.concat_ws(":", "hyp", F.col("n").cast("string")).alias("p"))
    best = first.groupBy(*keys, "word").agg(F.array_join(F.sort_array(F.collect_list(said))["p"], ";").alias("top_preds"))
    return beside(out, best, [*keys, "word"]).select(*keys, "word", "total", "correct", "top_preds", "accuracy")


def accuracy_pivot(accuracy: DataFrame, models: list[str]) -> DataFrame:
    """Words by models; 0 where a model has no such word."""
    return accuracy.groupBy("word").pivot("model", models).agg(F.first("accuracy")).na.fill(0.0, models)


def confusion_matrix(confusion: DataFrame, canonical: list[str]) -> DataFrame:
    """G14, long: (word, pred, n) for every two canonical words, 0 where they never met, and for every other prediction of a canonical word. Other words go."""
    seen = confusion.where(F.col("word").isin(canonical)).groupBy("word", "pred").agg(F.sum("n").alias("n"))
    every = lambda name: F.explode(F.array(*map(F.lit, canonical))).alias(name)
    cells = confusion.sparkSession.range(1).select(every("word")).select("word", every("pred"), F.lit(0).cast("long").alias("n"))
    return seen.unionByName(cells).groupBy("word", "pred").agg(F.sum("n").alias("n"))


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """G22."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def set_profile(manifest: DataFrame, key: str) -> DataFrame:
    """Utterances, non-blank texts, those that the normal form empties, words and speakers of each set, and the level at which it can be resampled."""
    blank = F.length(F.trim("text")) == 0
    out = manifest.groupBy(key).agg(
        F.count(F.lit(1)).alias("utterances"), F.count_if(~blank).alias("non_blank"), F.count_if(~blank & (F.col("words") == 0)).alias("empty_after_norm"),
        F.sum("words").alias("words"), F.countDistinct("speaker").alias("speakers"),
    )
    level = F.when(F.col("speakers") == F.col("utterances"), "utterance-level").when(F.col("speakers") < 10, "speaker-level (few speakers)").otherwise("speaker-level")
    return out.withColumn("level", level)


def length_scatter(edits: DataFrame) -> DataFrame:
    """One point (model, words, wer) per utterance."""
    return edits.select("model", "words", ratio(F.col("errors"), F.col("words")).alias("wer"))


def align_models(edits: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """The rows of two models side by side, in one pass. The job fails when a key is missing on one side, twice, or its words differ."""
    of = lambda m, c, x: F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{x}")
    n = lambda m, x: F.count_if(F.col("model") == m).alias(f"_{x}")
    both = edits.where(F.col("model").isin(a, b)).groupBy(*keys).agg(n(a, "a"), n(b, "b"), *[of(m, c, x) for m, x in ((a, "a"), (b, "b")) for c in ("words", "errors")])
    good = (F.col("_a") == 1) & (F.col("_b") == 1) & (F.col("words_a") == F.col("words_b"))
    said = F.concat(F.lit(f"models {a} and {b} do not meet once, with equal words, at "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(good, F.col("words_a")).otherwise(F.raise_error(said).cast("long"))
    return both.select(*keys, checked.alias("words_a"), "errors_a", "words_b", "errors_b")


def comparison_product(pairs: DataFrame, sets: DataFrame, available: DataFrame) -> DataFrame:
    """Every model pair on every set for which both models have results; the three tables are tiny registries."""
    named = pairs.crossJoin(sets)
    for m in ("model_a", "model_b"):
        named = named.join(available.select(F.col("model").alias(m), "test_set").distinct(), [m, "test_set"], "left_semi")
    return named


def gap_summary(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, least and largest gap change, languages, and significant reductions and increases."""
    return decided.groupBy(*keys).agg(
        F.avg("gap_delta").alias("mean_gap"), F.min("gap_delta").alias("min_gap"), F.max("gap_delta").alias("max_gap"), F.countDistinct("language").alias("languages"),
        F.count_if(F.contains("decision", F.lit("reduces"))).alias("reductions"), F.count_if(F.contains("decision", F.lit("increases"))).alias("increases"),
    )
