"""Expert-routing analytics.

Canonical form: one row per (model, utterance, layer) with `probs array<double>`; group distributions are long, one row
per expert, and divergences are sums over experts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.operators.ranks import hash_order, hash_range, numbered_by_value
from vocalith.operators.resample import resampled_sums
from vocalith.operators.stats import percentile_ci


def softmax(logits: Column) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, b: a + b)


def renormalise(p: Column) -> Column:
    """M5: divide by the sum where it is positive."""
    return F.when(_total(p) > 0, F.transform(p, lambda x: x / _total(p))).otherwise(p)


def router_entropy(p: Column) -> Column:
    """M3: entropy in nats of the renormalised distribution, with 1e-10 inside the logarithm."""
    return F.aggregate(renormalise(p), F.lit(0.0), lambda a, x: a - x * F.log(x + 1e-10))


def top1(p: Column) -> Column:
    """M4: index of the largest, the first on ties."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def top2(p: Column) -> Column:
    """M4: index of the second largest, the first on ties."""
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.get(ranked, 1)["i"]


def routing_from_frames(frames: DataFrame, keys: list[str], logits: str = "logits") -> DataFrame:
    """Softmax per frame, mean per (keys), then entropy and the two first experts."""
    p = frames.select(*keys, F.posexplode(softmax(F.col(logits))).alias("expert", "p"))
    mean = p.groupBy(*keys, "expert").agg(F.avg("p").alias("p"))
    row = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("expert", "p"))), lambda x: x["p"]).alias("probs"))
    return row.withColumns({"router_entropy": router_entropy(F.col("probs")), "top1_expert": top1(F.col("probs")), "top2_expert": top2(F.col("probs"))})


def hard_load(frames: DataFrame, keys: list[str], topk: str = "topk") -> DataFrame:
    """How often each expert is among the chosen, and its share."""
    n = frames.select(*keys, F.explode(topk).alias("expert")).groupBy(*keys, "expert").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def top1_load(frames: DataFrame, keys: list[str], topk: str = "topk") -> DataFrame:
    """Frames per first choice, all frames, and the modal expert (the lowest on ties, -1 without frames)."""
    n = frames.select(*keys, F.get(topk, 0).alias("expert")).groupBy(*keys, "expert").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    modal = F.max(F.when(F.col("expert").isNotNull(), F.struct(F.col("n"), (-F.col("expert")).alias("e")))).over(w)
    out = n.withColumns({"frames": F.sum("n").over(w), "modal_expert": F.coalesce(-modal["e"], F.lit(-1))})
    return out


def weighted_distribution(routing: DataFrame, keys: list[str], weight: str = "duration_sec") -> DataFrame:
    """Duration-weighted mean distribution per key, long: (keys, expert, p).

    Null and NaN weights are left out; a zero total gives zeros; without the column all rows weigh alike.
    """
    w = (F.col(weight) if weight in routing.columns else F.lit(1)).cast("double")
    rows = routing.where(w.isNotNull() & ~F.isnan(w)).select(*keys, w.alias("_w"), F.posexplode("probs").alias("expert", "_p"))
    sums = rows.groupBy(*keys, "expert").agg(F.sum(F.col("_p") * F.col("_w")).alias("s"))
    total = F.sum("s").over(Window.partitionBy(*keys))
    return sums.select(*keys, "expert", F.when(total > 0, F.col("s") / total).otherwise(0.0).alias("p"))


def jsd_term(p: Column, q: Column) -> Column:
    """M1: one expert's share of the Jensen-Shannon divergence in bits."""
    half = lambda x: F.when(x > 0, 0.5 * x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return half(p) + half(q)


def jsd_between(dist: DataFrame, keys: list[str], side: str, a: str, b: str) -> DataFrame:
    """JSD per key between two values of a column; null when a side is missing or empty."""
    pick = lambda v: F.max(F.when(F.col(side) == v, F.col("p")))
    both = dist.where(F.col(side).isin(a, b)).groupBy(*keys, "expert").agg(pick(a).alias("p"), pick(b).alias("q"))
    term = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), jsd_term(F.col("p"), F.col("q")))
    out = both.groupBy(*keys).agg(F.sum(term).alias("s"), F.sum("p").alias("a"), F.sum("q").alias("b"))
    return out.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("s")).alias("jsd"))


def language_pairs(dist: DataFrame, keys: list[str], language: str = "language") -> DataFrame:
    """JSD of every unordered pair of languages per key."""
    a = dist.select(*keys, "expert", F.col(language).alias("lang_a"), "p")
    b = dist.select(*keys, "expert", F.col(language).alias("lang_b"), F.col("p").alias("q"))
    both = a.join(b, [*keys, "expert"]).where("lang_a < lang_b")
    return both.groupBy(*keys, "lang_a", "lang_b").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd"))


def named_pairs(dist: DataFrame, keys: list[str], side: str, pairs: DataFrame) -> DataFrame:
    """JSD per key of every listed pair; pairs: a few rows (pair_a, pair_b), two values of the column side."""
    a = dist.select(*keys, "expert", F.col(side).alias("pair_a"), "p").join(pairs.select("pair_a", "pair_b"), "pair_a")
    b = dist.select(*keys, "expert", F.col(side).alias("pair_b"), F.col("p").alias("q"))
    both = a.join(b, [*keys, "expert", "pair_b"])
    return both.groupBy(*keys, "pair_a", "pair_b").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd"))


def pair_mean_peak(pairs: DataFrame) -> DataFrame:
    """Mean and largest JSD of each language pair, without NaN and null."""
    ok = pairs.where(F.col("jsd").isNotNull() & ~F.isnan("jsd"))
    return ok.groupBy("lang_a", "lang_b").agg(F.avg("jsd").alias("mean_jsd"), F.max("jsd").alias("peak_jsd"))


def expert_delta(dist: DataFrame, keys: list[str], top_k: int, side: str = "age_group", a: str = "adult", b: str = "child") -> DataFrame:
    """M6: (p of b - p of a) * top_k per expert."""
    pick = lambda v: F.max(F.when(F.col(side) == v, F.col("p")))
    return dist.groupBy(*keys, "expert").agg(((pick(b) - pick(a)) * top_k).alias("delta"))


def load_deviation(dist: DataFrame, top_k: int, experts: int) -> DataFrame:
    """M7: expected selections minus those of an even load."""
    return dist.withColumn("deviation", F.col("p") * top_k - top_k / experts)


def peak_layer(curve: DataFrame, keys: list[str], value: str = "jsd") -> DataFrame:
    """The layer of the largest value, the first on ties."""
    m = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col("layer_idx")).alias("l"))))
    return curve.groupBy(*keys).agg(m.alias("m")).select(*keys, (-F.col("m.l")).alias("peak_layer"), F.col("m.v").alias("peak_value"))


def preferred_experts(delta: DataFrame, keys: list[str]) -> DataFrame:
    """The experts with the largest and the smallest delta, the lowest index on ties."""
    hi = F.max(F.struct(F.col("delta").alias("d"), (-F.col("expert")).alias("e")))
    lo = F.min(F.struct(F.col("delta").alias("d"), F.col("expert").alias("e")))
    return delta.groupBy(*keys).agg(hi.alias("h"), lo.alias("l")).select(*keys, (-F.col("h.e")).alias("child_expert"), F.col("h.d").alias("child_delta"), F.col("l.e").alias("adult_expert"), F.col("l.d").alias("adult_delta"))


#: Layers that fill up the key layers, in order.
FALLBACK_LAYERS = [4, 5, 13, 14]


def key_layers(peaks: DataFrame, n: int = 4) -> DataFrame:
    """The distinct peak layers, filled up from the fallback to n, of which the n lowest stay."""
    spark = peaks.sparkSession
    own = peaks.where("peak_layer is not null").select("peak_layer").distinct().select(F.col("peak_layer").cast("int").alias("layer_idx"), F.lit(-1).alias("rank"))
    more = spark.createDataFrame([(x, i) for i, x in enumerate(FALLBACK_LAYERS)], "layer_idx int, rank int")
    ranked = own.unionByName(more).groupBy("layer_idx").agg(F.min("rank").alias("rank"))
    need = ranked.withColumn("peaks", F.count_if(F.col("rank") < 0).over(Window.partitionBy()))  # a row per layer
    place = F.row_number().over(Window.partitionBy(F.col("rank") < 0).orderBy("rank", "layer_idx"))
    chosen = need.withColumn("place", place).where((F.col("rank") < 0) | (F.col("place") <= n - F.col("peaks")))
    return chosen.orderBy("layer_idx").limit(n).select("layer_idx")


def cross_tab(delta: DataFrame, layers: DataFrame, languages: list[str]) -> DataFrame:
    """M8: experts by languages at the key layers."""
    return delta.join(layers, "layer_idx", "left_semi").groupBy("layer_idx", "expert").pivot("language", languages).agg(F.first("delta"))


def child_preferred_sets(delta: DataFrame, keys: list[str]) -> DataFrame:
    """U4: the sorted set of experts with positive delta."""
    return delta.where("delta > 0").groupBy(*keys).agg(F.array_sort(F.collect_set("expert")).alias("experts"))


def layers_above_zero(ci: DataFrame, keys: list[str]) -> DataFrame:
    """W7."""
    return ci.groupBy(*keys).agg(F.count_if(F.col("ci_low") > 0).alias("layers_above_zero"))


def jsd_bootstrap(routing: DataFrame, keys: list[str], replicates: int = 500, seed: int = 777, unit: str = "utterance", side: str = "age_group", a: str = "adult", b: str = "child", experts: int | None = None) -> DataFrame:
    """(keys, layer_idx, replicate, jsd) with units drawn with replacement inside each side.

    unit="utterance" draws utterances with all their layers; unit="row" draws (utterance, layer) rows from all rows of a
    side, whatever their layer, so that a layer's number of rows varies. Vectors are weighted by duration once. experts is
    counted where it is not given. A replicate that misses a side at a layer has a null.
    """
    rows = routing.where(F.col(side).isin(a, b) & F.col("duration_sec").isNotNull() & ~F.isnan("duration_sec"))
    experts = experts or rows.agg(F.max(F.size("probs")).alias("e")).first().e or 0
    group, own = [*keys, side], ["utterance_id"] if unit == "utterance" else ["utterance_id", "layer_idx"]
    weighted = [F.get("probs", e) * F.col("duration_sec") for e in range(experts)]
    sums = resampled_sums(rows, group, own, weighted, replicates, seed, cell="layer_idx")
    total = F.aggregate("sums", F.lit(0.0), lambda x, y: x + y)
    mine = lambda v: F.max(F.when((F.col(side) == v) & (total > 0), F.transform("sums", lambda x: x / total)))
    both = sums.groupBy(*keys, "layer_idx", "replicate").agg(mine(a).alias("p"), mine(b).alias("q"))
    terms = F.zip_with("p", "q", jsd_term)
    return both.select(*keys, "layer_idx", "replicate", F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("jsd"))


def ci_table(replicates: DataFrame, keys: list[str], points: DataFrame | None = None) -> DataFrame:
    """Limits of every key; a key of points (a curve) that has no replicate has null limits."""
    lo, hi = percentile_ci(F.col("jsd"))
    found = replicates.groupBy(*keys).agg(lo.alias("ci_low"), hi.alias("ci_high"))
    return found if points is None else points.select(*keys).distinct().join(found, keys, "left")


def routing_summary(curve: DataFrame, delta: DataFrame, ci: DataFrame, keys: list[str]) -> DataFrame:
    """Peak layer and value, preferred experts there, interval there, layers whose interval is above zero."""
    peaks = peak_layer(curve, keys)
    at = delta.join(peaks.withColumnRenamed("peak_layer", "layer_idx").drop("peak_value"), [*keys, "layer_idx"], "left_semi")
    there = ci.join(peaks.select(*keys, F.col("peak_layer").alias("layer_idx")), [*keys, "layer_idx"], "left_semi").drop("layer_idx")
    return peaks.join(preferred_experts(at, keys), keys, "left").join(there, keys, "left").join(layers_above_zero(ci, keys), keys, "left")


def mono_vs_multi(mono: DataFrame, multi: DataFrame) -> DataFrame:
    """Two JSD curves side by side by layer."""
    return mono.select("layer_idx", F.col("jsd").alias("mono_jsd")).join(multi.select("layer_idx", F.col("jsd").alias("multi_jsd")), "layer_idx")


def _cumulative(utterances: DataFrame, keys: list[str], order: Column, duration: str) -> DataFrame:
    """Running total of duration before each row in the order inside its group.

    Two levels, so that a group may be larger than a task: hash ranges of the order are summed, the few range totals are
    accumulated per group, and rows accumulate inside their range only.
    """
    o = utterances.withColumn("_o", order).withColumn("_r", hash_range(F.col("_o")))
    totals = o.groupBy(*keys, "_r").agg(F.sum(duration).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_t")
    inside = F.coalesce(F.sum(duration).over(Window.partitionBy(*keys, "_r").orderBy("_o", "utterance_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return o.join(before, [*keys, "_r"]).withColumn("_cum", F.col("_before") + inside)


def duration_cap(routing: DataFrame, keys: list[str], seconds: float = 4 * 3600.0, seed: int = 1) -> DataFrame:
    """Whole utterances in random order per group until their duration reaches the cap; the crossing one stays, with all its layers."""
    utt = routing.where("layer_idx = 0").where(F.col("duration_sec").isNotNull() & ~F.isnan("duration_sec")).groupBy(*keys, "utterance_id").agg(F.min("duration_sec").alias("d"))
    picked = _cumulative(utt, keys, hash_order(seed), "d").where(F.col("_cum") < seconds)
    return routing.join(picked.select(*keys, "utterance_id"), [*keys, "utterance_id"], "left_semi")


def duration_match(routing: DataFrame, keys: list[str], side: str = "age_group", seed: int = 1) -> DataFrame:
    """Rows of the longer side of each key are cut, in random order, to the total of the shorter; the crossing row stays."""
    rows = routing.where(F.col("duration_sec").isNotNull() & ~F.isnan("duration_sec")).withColumnRenamed("utterance_id", "_u").withColumn("utterance_id", F.concat_ws("/", "_u", "layer_idx"))
    totals = rows.groupBy(*keys, side).agg(F.sum("duration_sec").alias("_total"))
    target = totals.groupBy(*keys).agg(F.min("_total").alias("_target"))
    out = _cumulative(rows, [*keys, side], hash_order(seed), "duration_sec").join(target, keys).where(F.col("_cum") < F.col("_target"))
    return out.drop("utterance_id", "_o", "_r", "_before", "_cum", "_target").withColumnRenamed("_u", "utterance_id").select(*routing.columns)


def drop_incomplete(routing: DataFrame, keys: list[str], layers: int) -> DataFrame:
    """Only utterances with exactly so many layers."""
    whole = routing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == layers)
    return routing.join(whole, keys, "left_semi")


def group_coverage(routing: DataFrame, keys: list[str]) -> DataFrame:
    """Per group distinct utterances and summed hours from layer 0, and the layers, groups and datasets seen anywhere."""
    first = F.col("layer_idx") == 0
    return routing.groupBy(*keys).agg(
        F.countDistinct(F.when(first, F.col("utterance_id"))).alias("utterances"), (F.coalesce(F.sum(F.when(first, F.col("duration_sec"))), F.lit(0.0)) / 3600).alias("hours"),
        F.array_sort(F.collect_set("layer_idx")).alias("layers"), F.array_sort(F.collect_set("age_group")).alias("groups"), F.array_sort(F.collect_set("dataset_source")).alias("datasets"),
    )


def prob_sanity(routing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, mean, spread, least, quartiles and largest of the sums (to nine digits, so that few differ), least and largest probability, rows whose sum is off one by over 0.001."""
    rows = routing.withColumn("_s", F.round(_total(F.col("probs")), 9))
    s = F.col("_s")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_sum"), F.stddev(s).alias("std_sum"), F.min(s).alias("min_sum"), *[F.percentile(s, q / 4).alias(f"q{q}_sum") for q in (1, 2, 3)], F.max(s).alias("max_sum"),
        F.min(F.array_min("probs")).alias("min_p"), F.max(F.array_max("probs")).alias("max_p"), F.count_if((s < 0.999) | (s > 1.001)).alias("bad"),
    )


def linspace_subsample(frames: DataFrame, keys: list[str], order: str, most: int = 20_000) -> DataFrame:
    """At most `most` rows per key, evenly spaced from the first to the last in the order of a number."""
    ranked = numbered_by_value(frames, keys, order)
    if most == 1:
        return ranked.where("_i = 0").drop("_i", "_n")
    # k*(n-1)/(most-1) has its floor at i for some k exactly when the next multiple reaches i
    k = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    hit = F.floor(k * (F.col("_n") - 1) / (most - 1)) == F.col("_i")
    return ranked.where((F.col("_n") <= most) | hit).drop("_i", "_n").select(frames.columns)


def cosine_matrix(vectors: DataFrame, keys: list[str], frame: str = "frame_idx") -> DataFrame:
    """Mean over frames of the cosine between the vectors of every two experts on the same frame."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    unit = vectors.select(*keys, frame, F.struct("expert", F.transform("vec", lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("v")).alias("e"))
    # The vectors of a frame meet once, as many as there are experts; their Gram matrix is added up where they met.
    frames = unit.groupBy(*keys, frame).agg(F.collect_list("e").alias("e"))
    cell = lambda a, b: F.struct(a["expert"].alias("expert_a"), b["expert"].alias("expert_b"), dot(a["v"], b["v"]).alias("c"))
    gram = frames.select(*keys, F.explode(F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: cell(a, b))))).alias("g"))
    return gram.groupBy(*keys, "g.expert_a", "g.expert_b").agg(F.avg("g.c").alias("cosine"))
