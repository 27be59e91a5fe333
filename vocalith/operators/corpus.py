"""Corpus preparation (P1-P10, C1-C14, J13) as jobs over manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.functions.text import basename, path_candidates, words
from vocalith.operators.align import word_edit_distance
from vocalith.operators.ranks import numbered_by_hash, quantiles, running_total


def drop_empty_reference(manifest: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose raw text is not blank; F.count_if over `is_empty_reference` gives the number dropped."""
    return manifest.where(~is_empty_reference(text))


def is_empty_reference(text: str = "text") -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == ""


def tag_constants(df: DataFrame, **tags: str) -> DataFrame:
    """P2."""
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def coalesce_duration(df: DataFrame, to: str = "duration_sec") -> DataFrame:
    """Duration, else duration_sec, as double; null where neither can be read."""
    parts = [F.col(c).cast("string").try_cast("double") for c in ("duration", "duration_sec") if c in df.columns]
    return df.withColumn(to, F.coalesce(*parts) if parts else F.lit(None).cast("double"))


def drop_missing_duration(df: DataFrame, duration: str = "duration_sec") -> DataFrame:
    """P6."""
    return df.where(F.col(duration).isNotNull() & ~F.isnan(duration))


def duration_range(df: DataFrame, least: float, most: float, duration: str = "duration_sec") -> DataFrame:
    """P8."""
    return df.where(F.col(duration).between(least, most))


def select_languages(df: DataFrame, wanted: list[str], paths: DataFrame | None = None) -> DataFrame:
    """P5: wanted languages that exist; paths (language, path) override the registered ones."""
    out = df.where(F.col("language").isin(wanted))
    if paths is None:
        return out
    own = paths.select("language", F.col("path").alias("_path"))
    return out.join(own, "language", "left").withColumn("path", F.coalesce("_path", "path")).drop("_path")


def skip_missing_entries(manifest: DataFrame, files: DataFrame, path: str = "audio_filepath") -> DataFrame:
    """Manifest rows whose file is listed; the anti join of the same two tables is what was skipped."""
    return manifest.join(files.select(path).distinct(), path, "left_semi")


def extraction_accounting(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """P10: processed, skipped, failed and incomplete rows, and where the processed came from."""
    n = lambda v: F.count_if(F.col(status) == v).alias(v)
    return rows.groupBy(*keys).agg(*[n(v) for v in ("processed", "skipped", "failed", "incomplete")], *[F.count_if((F.col(status) == "processed") & (F.col("origin") == v)).alias(f"from_{v}") for v in ("tar", "disk")])


def to_manifest(df: DataFrame, path: Column, duration: Column, text: Column) -> DataFrame:
    """C1."""
    return df.select(path.alias("audio_filepath"), duration.cast("double").alias("duration"), text.alias("text"))


def filter_utterances(manifest: DataFrame, least: float = 0.5, flags: tuple[str, ...] = ()) -> DataFrame:
    """Without empty texts, clips under `least` seconds, and rows with one of the boolean flags (non-speech, clipped)."""
    out = drop_empty_reference(manifest).where(F.col("duration") >= least)
    for f in flags:
        out = out.where(~F.coalesce(F.col(f), F.lit(False)))
    return out


def oracle_wer_filter(manifest: DataFrame, ref: str, oracle: str, most: float = 0.5) -> DataFrame:
    """Rows whose oracle transcript is off by at most so many errors per reference word."""
    r, h = words(F.col(ref)), words(F.col(oracle))
    return manifest.where(word_edit_distance(r, h) <= most * F.size(r))


def pack_short_clips(manifest: DataFrame, seconds: float, speaker: str = "speaker", order: str = "audio_filepath", silent: bool = False) -> DataFrame:
    """C4: clips of a speaker, in order, in groups of about so many seconds: (speaker, pack, clips, duration, text).

    The seconds before a clip are a running total over ranges, so a speaker's clips may lie in many tasks, and what is
    gathered is one pack. Clips of equal order stand by their text, those without an order last. A clip without a positive
    duration holds no sound and goes; with silent it stays.
    """
    placed = running_total(manifest if silent else manifest.where("duration > 0"), [speaker], [order, "text"], "duration", "_sec")
    grouped = placed.withColumn("pack", (F.col("_sec") / seconds).cast("long"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).isNull().alias("_last"), order, "text"))), lambda x: x["text"]), " ")
    return grouped.groupBy(speaker, "pack").agg(F.count(F.lit(1)).alias("clips"), F.sum("duration").alias("duration"), texts.alias("text"))


def hash_unit(c: Column, seed: int) -> Column:
    """A number in [0, 1) from a value and a seed, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def speaker_split(df: DataFrame, speaker: str = "speaker", seed: int = 0, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """`split` train, dev or test; all rows of a speaker share one."""
    u = hash_unit(F.col(speaker), seed)
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < sum(shares), "dev").otherwise("test"))


def word_speaker_split(df: DataFrame, word: str, speaker: str, seed: int = 0, share: float = 0.8) -> DataFrame:
    """Train and test share neither words nor speakers; rows that would mix the two go."""
    w, s = hash_unit(F.col(word), seed) < share, hash_unit(F.col(speaker), seed + 1) < share
    return df.withColumn("split", F.when(w & s, "train").when(~w & ~s, "test")).where("split is not null")


def cohort_filter(df: DataFrame, people: DataFrame, on: str, condition: Column) -> DataFrame:
    """Rows of people who meet a condition on their metadata; their split stays."""
    return df.join(people.where(condition).select(on).distinct(), on, "left_semi")


def clean_transcription(c: Column, tokens: tuple[str, ...] = ()) -> Column:
    """Without <..>, [..] and (..) tokens, truncation marks (- or * at a word's end) and the given non-speech tokens."""
    t = F.regexp_replace(c, r"<[^>]*>|\[[^\]]*\]|\([^)]*\)", " ")
    t = F.regexp_replace(t, r"(?U)(?<=\w)[-*]+(?=\s|$)", "")
    for x in tokens:
        t = F.regexp_replace(t, rf"(?U)(?<!\S){x}(?!\S)", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def spelled_transcription(df: DataFrame, key: str, text: str, spelling: DataFrame, tokens: tuple[str, ...] = ()) -> DataFrame:
    """(key, text) with cleaned transcriptions in which words that spelling (sound, word) knows are written its way.

    key names the rows. A sound with several spellings takes the first in order; words it does not know stay.
    """
    said = df.select(key, F.posexplode_outer(words(clean_transcription(F.col(text), tokens))).alias("_i", "_w"))
    known = spelling.groupBy(F.col("sound").alias("_w")).agg(F.min("word").alias("_s"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", F.coalesce("_s", "_w").alias("w")))))  # the words of one row
    return said.join(known, "_w", "left").groupBy(key).agg(F.array_join(F.transform(in_order, lambda x: x["w"]), " ").alias(text))


def mixture_weights(sources: DataFrame) -> DataFrame:
    """`share`: each source's weight (absent: 1) over all."""
    w = F.coalesce("weight", F.lit(1.0))
    return sources.withColumn("share", w / F.sum(w).over(Window.partitionBy()))  # a row per source


def mixture_sample(rows: DataFrame, shares: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly `size` rows, in which the sources that have rows hold their shares, whole numbers by cumulative rounding.

    Systematic sampling: of a source's n rows in hash order, of which t are asked for, row i stands as often as multiples
    of n/t fall between i and i + 1, so `copy` counts from 1 to floor or ceiling of t/n. Places are counted in two levels.
    """
    placed = numbered_by_hash(rows, ["source"], F.col(key), "_i", "_n", seed)
    present = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_m")).join(shares.select("source", "share"), "source")
    up_to = F.round(F.lit(size) * F.sum("share").over(Window.orderBy("source")) / F.sum("share").over(Window.partitionBy()))  # a row per source
    asked = present.withColumn("_u", up_to).withColumn("_t", (F.col("_u") - F.coalesce(F.lag("_u").over(Window.orderBy("source")), F.lit(0.0))).cast("long"))
    out = placed.join(asked.select("source", "_t"), "source")
    copies = F.expr("(_i + 1) * _t div _n - _i * _t div _n").cast("int")
    return out.withColumn("_c", copies).where("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_i", "_n", "_t", "_c")


def exposure_plan(sources: DataFrame) -> DataFrame:
    """Hours drawn from each source in an epoch as long as all hours, repeats, and hours never seen."""
    w, every = F.coalesce("weight", F.lit(1.0)), Window.partitionBy()
    drawn = w / F.sum(w).over(every) * F.sum("hours").over(every)
    return sources.withColumn("drawn_hours", drawn).withColumn("repeats", F.col("drawn_hours") / F.col("hours")).withColumn("unseen_hours", F.greatest(F.lit(0.0), F.col("hours") - F.col("drawn_hours")))


def hour_proportional_split(sources: DataFrame, budget: str = "budget") -> DataFrame:
    """C11: a language's budget split over its corpora by hours."""
    return sources.withColumn("portion", F.col(budget) * F.col("hours") / F.sum("hours").over(Window.partitionBy("language")))


def duration_buckets(manifest: DataFrame, edges: list[float], batch_sizes: list[int], duration: str = "duration") -> DataFrame:
    """Per duration bin: utterances, hours, batch size and batches. A value on an edge belongs to the bin above; the last bin is open."""
    b = F.lit(0)
    for e in edges:
        b = b + F.when(F.col(duration) >= e, 1).otherwise(0)
    out = manifest.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("utterances"), (F.sum(duration) / 3600).alias("hours"))
    size = F.get(F.array(*map(F.lit, batch_sizes)), F.col("bucket"))
    return out.withColumn("batch_size", size).withColumn("batches", F.ceil(F.col("utterances") / F.col("batch_size")))


def bucket_quantiles(manifest: DataFrame, bins: int = 30, duration: str = "duration") -> DataFrame:
    """The edges that part the durations into bins of equal counts."""
    return quantiles(manifest, duration, [i / bins for i in range(1, bins)]).select(F.col("i").alias("edge"), F.col("quantile").alias("seconds"))


def corpus_stats(df: DataFrame, text: str = "text", unit: str = "word", lower: bool = True) -> DataFrame:
    """C14: (token, n, share, coverage): counts of words or characters and the share of all that the tokens so far cover.

    Coverage is accumulated over the distinct counts, of which there are few, and not over the tokens.
    """
    t = F.lower(text) if lower else F.col(text)
    tokens = words(t) if unit == "word" else F.filter(F.split(t, ""), lambda x: (x != "") & ~x.rlike(r"(?U)^\s$"))
    n = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("n").agg((F.count(F.lit(1)) * F.col("n")).alias("_mass"))
    w = Window.orderBy(F.desc("n"))  # a row per distinct count
    per = per.select("n", F.sum("_mass").over(w).alias("_sum"), F.sum("_mass").over(Window.partitionBy()).alias("_all"))
    return n.join(per, "n").select("token", "n", (F.col("n") / F.col("_all")).alias("share"), (F.col("_sum") / F.col("_all")).alias("coverage"))


def resolve_members(manifest: DataFrame, index: DataFrame, on_disk: DataFrame | None = None, path: str = "audio_filepath") -> DataFrame:
    """Manifest with `member` and `origin`: a file on disk, else the archive member of the first path candidate that is a member's name or, failing that, its base name; of equal base names the first in name order counts."""
    asked = manifest.select(path).distinct().select(path, F.posexplode(path_candidates(F.col(path))).alias("priority", "cand")).withColumn("cand", F.regexp_replace("cand", "^/+", ""))
    name = F.translate("member_name", "\\", "/")
    by_name = index.select(F.regexp_replace(name, "^/+", "").alias("cand"), F.col("member_name").alias("m")).groupBy("cand").agg(F.min("m").alias("exact"))
    by_base = index.select(basename(name).alias("base"), F.col("member_name").alias("m")).where("base <> ''").groupBy("base").agg(F.min("m").alias("loose"))
    found = asked.withColumn("base", basename(F.col("cand"))).join(by_name, "cand", "left").join(by_base, "base", "left").withColumn("member", F.coalesce("exact", "loose")).where("member is not null")
    first = found.groupBy(path).agg(F.min_by("member", "priority").alias("member"))
    out = manifest.join(first, path, "left")
    if on_disk is None:
        return out.withColumn("origin", F.when(F.col("member").isNotNull(), "tar"))
    disk = on_disk.select(path).distinct().withColumn("_disk", F.lit(True))
    out = out.join(disk, path, "left").withColumn("origin", F.when(F.col("_disk"), "disk").when(F.col("member").isNotNull(), "tar"))
    return out.withColumn("member", F.when(F.col("_disk").isNull(), F.col("member"))).drop("_disk")
