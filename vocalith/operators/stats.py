"""Resampling and inference (R1-R10, W3, M11). Draws are hashes of (seed, keys, replicate, slot), so they follow neither partitions nor order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.operators.ranks import beside, over_ranges, value_ranges
from vocalith.operators.resample import resampled_sums
from vocalith.sources.scratch import stored


def speaker_units(edits: DataFrame, keys: list[str], a: str, b: str, unit: str = "speaker") -> DataFrame:
    """(keys, unit, errors_a, errors_b, words) in one scan; words are those of model a's rows."""
    of = lambda m, c: F.sum(F.when(F.col("model") == m, F.col(c)).otherwise(0))
    return edits.where(F.col("model").isin(a, b)).groupBy(*keys, unit).agg(of(a, "errors").alias("errors_a"), of(b, "errors").alias("errors_b"), of(a, "words").alias("words"))


def paired_bootstrap(units: DataFrame, keys: list[str], replicates: int = 10_000, seed: int = 12345, unit: str = "speaker") -> DataFrame:
    """(keys, replicate, diff): WER of a minus WER of b, in points, when units are drawn with replacement."""
    s = resampled_sums(units, keys, [unit], [F.col(c) for c in ("errors_a", "errors_b", "words")], replicates, seed)
    a, b, words = (F.get("sums", i) for i in range(3))
    return s.select(*keys, "replicate", (100.0 * (a - b) / F.when(words > 0, words)).alias("diff"))


def two_sided(diff: Column) -> Column:
    above, below = F.avg((diff > 0).cast("double")), F.avg((diff < 0).cast("double"))
    return F.least(F.lit(1.0), 2 * F.least(above, below))


def percentile_ci(value: Column) -> tuple[Column, Column]:
    """Exact 2.5 and 97.5 percentiles with linear interpolation."""
    return F.percentile(value, 0.025), F.percentile(value, 0.975)


def compare_models(units: DataFrame, keys: list[str], replicates: int = 10_000, seed: int = 12345, unit: str = "speaker") -> DataFrame:
    """Observed WERs and difference (points), its interval, p-value and number of units."""
    seen = units.groupBy(*keys).agg(F.sum("errors_a").alias("a"), F.sum("errors_b").alias("b"), F.sum("words").alias("w"), F.count(F.lit(1)).alias("n_units"))
    lo, hi = percentile_ci(F.col("diff"))
    boot = paired_bootstrap(units, keys, replicates, seed, unit).groupBy(*keys).agg(lo.alias("ci_low"), hi.alias("ci_high"), two_sided(F.col("diff")).alias("p"))
    pct = lambda c: 100.0 * F.col(c) / F.when(F.col("w") > 0, F.col("w"))
    return seen.join(boot, keys).select(*keys, pct("a").alias("wer_a"), pct("b").alias("wer_b"), (pct("a") - pct("b")).alias("diff"), "ci_low", "ci_high", "p", "n_units")


def gap_bootstrap(adult: DataFrame, child: DataFrame, keys: list[str], replicates: int = 10_000, seed: int = 24680, unit: str = "speaker") -> DataFrame:
    """(keys, gap_delta, ci_low, ci_high, p): (child-adult gap of a) - (gap of b); both sides are drawn independently."""
    lo, hi = percentile_ci(F.col("g"))
    a = paired_bootstrap(adult, keys, replicates, seed, unit).withColumnRenamed("diff", "da")
    c = paired_bootstrap(child, keys, replicates, seed + 1, unit).withColumnRenamed("diff", "dc")
    boot = a.join(c, [*keys, "replicate"]).withColumn("g", F.col("dc") - F.col("da")).groupBy(*keys).agg(lo.alias("ci_low"), hi.alias("ci_high"), two_sided(F.col("g")).alias("p"))
    point = lambda u, name: u.groupBy(*keys).agg((100.0 * (F.sum("errors_a") - F.sum("errors_b")) / F.sum("words")).alias(name))
    return point(child, "c").join(point(adult, "a"), keys).join(boot, keys).select(*keys, (F.col("c") - F.col("a")).alias("gap_delta"), "ci_low", "ci_high", "p")


def fdr_over_family(tests: DataFrame, family: list[str], q: float = 0.05, rounded: bool = False) -> DataFrame:
    """Benjamini-Hochberg inside each family: tests with p_adj and significant; rounded takes p at four digits.

    Tests of one p share their result, so the distinct values of a family are what is ranked: counted in ranges of values,
    then inside a range, and the least of all larger values likewise. A p that is null or NaN is no test: it counts for
    nothing, and its results are null.
    """
    p = F.bround("p", 4) if rounded else F.col("p")
    named = stored(tests.withColumn("_p", F.when(~F.isnan(p), p)), "tests")
    values = named.where("_p is not null").groupBy(*family, "_p").agg(F.count(F.lit(1)).alias("_c"))
    ranged = stored(value_ranges(values, family, "_p"), "ranges")
    per = ranged.groupBy(*family, "_r").agg(F.sum("_c").alias("_m"))
    inside = Window.partitionBy(*family, "_r")
    ranked = beside(ranged.withColumn("_i", F.sum("_c").over(inside.orderBy("_p"))), over_ranges(per, family, "_m", "_b", "_n"), [*family, "_r"])
    scaled = stored(ranked.withColumn("_k", F.col("_p") * F.col("_n") / (F.col("_b") + F.col("_i"))), "scaled")
    later = over_ranges(scaled.groupBy(*family, "_r").agg(F.min("_k").alias("_k")), family, "_k", "_a", later=True)
    least = beside(scaled.withColumn("_l", F.min("_k").over(inside.orderBy(F.desc("_p")))), later, [*family, "_r"])
    adjusted = least.select(*family, "_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_l", "_a")).alias("p_adj"))
    return beside(named, adjusted, [*family, "_p"], how="left").withColumn("significant", F.col("p_adj") <= q).drop("_p")


#: Verdicts of single tests, of paired tests over several languages, and of gap tests.
VERDICTS = {
    "none": "Fail to reject H0: no detectable WER difference.",
    "lower": "Reject H0: Model A has significantly lower WER.",
    "higher": "Reject H0 (opposite direction): Model A has significantly higher WER.",
    "on_lower": "Reject H0: LB-on has significantly lower WER than LB-off.",
    "on_higher": "Reject H0: LB-on has significantly higher WER than LB-off.",
}
PAIRED_VERDICTS = {
    "none": "No detectable difference.",
    "lower": "Significant: MoE has lower WER.",
    "higher": "Significant (opposite): MoE has higher WER.",
    "on_lower": "Significant: LB-on lower.",
    "on_higher": "Significant: LB-on higher.",
}
GAP_VERDICTS = {
    "reduces": "Significant: MoE reduces the adult-child gap.",
    "increases": "Significant (opposite): MoE increases the adult-child gap.",
    "none": "No detectable gap difference.",
    "lean": "No detectable gap difference (numerically %s for MoE).",
}


def decide(tests: DataFrame, verdicts: dict[str, str] = VERDICTS) -> DataFrame:
    """The verdict from significance, interval and expected direction; PAIRED_VERDICTS words it for several languages."""
    sig, d = F.col("significant"), F.col("direction")
    below, above = F.col("ci_high") < 0, F.col("ci_low") > 0
    verdict = (
        F.when(sig & (d == "negative") & below, verdicts["lower"])
        .when(sig & (d == "negative") & above, verdicts["higher"])
        .when(sig & (d == "either") & below, verdicts["on_lower"])
        .when(sig & (d == "either") & above, verdicts["on_higher"])
        .otherwise(verdicts["none"])
    )
    return tests.withColumn("decision", verdict)


def decide_gap(tests: DataFrame) -> DataFrame:
    """R9 for gap tests: does the sparse model change the adult-child gap?"""
    lean = F.format_string(GAP_VERDICTS["lean"], F.when(F.col("gap_delta") < 0, "smaller").otherwise("larger"))
    out = F.when(~F.col("significant"), lean).when(F.col("ci_high") < 0, GAP_VERDICTS["reduces"]).when(F.col("ci_low") > 0, GAP_VERDICTS["increases"]).otherwise(GAP_VERDICTS["none"])
    return tests.withColumn("decision", out)


def sentence(tests: DataFrame) -> DataFrame:
    """One sentence per test; estimates are rounded half to even."""
    text = F.format_string(
        # Fixed value: the sentence.
        "[%s] %s achieved %.2f%% WER and %s achieved %.2f%% WER. The difference was %+.3f pp (95%% CI [%.3f, %.3f], BH-adjusted p = %.4f). %s",
        "test_id", "model_a", F.bround("wer_a", 2), "model_b", F.bround("wer_b", 2), F.bround("diff", 3), F.bround("ci_low", 3), F.bround("ci_high", 3), F.bround("p_adj", 4), "decision",
    )
    return tests.withColumn("summary", text)


def paired_sentence(tests: DataFrame) -> DataFrame:
    """One sentence per language, age and pair of models; estimates are rounded half to even."""
    text = F.format_string(
        # Fixed value: the sentence.
        "[%s %s] %s %.2f%% vs %s %.2f%%. Diff = %+.3f pp (95%% CI [%.3f, %.3f], BH-adj p = %.4f). %s",
        "language", "age_group", "model_a", F.bround("wer_a", 2), "model_b", F.bround("wer_b", 2), F.bround("diff", 3), F.bround("ci_low", 3), F.bround("ci_high", 3), F.bround("p_adj", 4), "decision",
    )
    return tests.withColumn("summary", text)


def forest_table(tests: DataFrame, labels: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows of a forest plot: label, group and its place in an explicit order, estimate, interval, significance."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return tests.join(labels, "test_id").select("test_id", "label", group, place.alias("position"), "diff", "ci_low", "ci_high", "significant")
