"""Sources and sinks (S1-S6, K1-K5, U1, U2): manifests, hypotheses, edit and routing tables."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vocalith.sources.maps import read_maps

#: The columns of manifests, edit tables and routing tables.
MANIFEST = "audio_filepath string, duration double, duration_sec double, text string, speaker string, speaker_id string, spk_id string, client_id string, speaker_id_original string"
EDIT_COLUMNS = {"audio_filepath", "speaker", "words", "substitutions", "deletions", "insertions", "errors"}
ROUTING_COLUMNS = {"utterance_id", "age_group", "layer_idx", "duration_sec"}


def require(df: DataFrame, columns: set[str], what: str) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    lacking = sorted(columns - set(df.columns))
    if lacking:
        raise ValueError(f"{what} lacks the columns {lacking}")
    return df


def read_manifest(spark: SparkSession, paths: str | list[str], schema: str = MANIFEST) -> DataFrame:
    """JSON lines with `source_file`; blank lines are skipped, absent keys are null, bad JSON fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("source_file", F.col("_metadata.file_path"))


#: Lines of a head that are taken file by file; longer heads are cut by counting blocks.
HEAD_LINES = 10_000


def read_manifest_head(spark: SparkSession, path: str, n: int | None, schema: str = MANIFEST) -> DataFrame:
    """The first n non-blank lines in file order (files by name); None, 0 or less: all.

    A short head is read file by file, each from its start on, until there are enough lines, and nothing behind them is
    read. A long one counts the lines of blocks, keeps whole blocks and cuts the one in which the n-th line lies.
    """
    parsed = lambda lines: lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    lines = spark.read.text(path).where(F.trim("value") != "")
    if not n or n <= 0:
        return parsed(lines.select("value"))
    if n <= HEAD_LINES:
        taken: list[str] = []
        for file in sorted(lines.inputFiles()):
            # A limit that is collected reads partitions one after the other; of one file they lie in order.
            taken += [r.value for r in spark.read.text(unquote(file)).where(F.trim("value") != "").select("value").limit(n - len(taken)).collect()]
            if len(taken) >= n:
                break
        return parsed(spark.createDataFrame([(v,) for v in taken], "value string"))
    own = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    per = own.groupBy("f", "b").agg(F.count(F.lit(1)).alias("c"))  # a row per block
    before = per.withColumn("p", F.coalesce(F.sum("c").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("p") < n)
    inside = own.join(before, ["f", "b"])
    whole = inside.where(F.col("p") + F.col("c") <= n).select("value")
    cut = inside.where(F.col("p") + F.col("c") > n)
    return parsed(whole.unionByName(cut.withColumn("k", F.row_number().over(Window.partitionBy("f", "b").orderBy("i"))).where(F.col("k") <= F.lit(n) - F.col("p")).select("value")))


def read_multi_manifest(spark: SparkSession, tagged: list[tuple[str, dict[str, str]]], schema: str = MANIFEST) -> DataFrame:
    """S3: several manifests in one table with their tags; paths that do not exist are skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [(p, t) for p, t in tagged if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not found:
        return spark.createDataFrame([], StructType.fromDDL(schema))
    return union_groups([read_manifest(spark, p, schema).withColumns({k: F.lit(v) for k, v in t.items()}) for p, t in found])


def read_hypotheses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """hyp__MODEL__SET.json, each one JSON map of path to text, of any size, or a folder of such maps, as rows (model, test_set, audio_filepath, hyp)."""
    maps = read_maps(spark, paths)
    name = lambda k: F.regexp_extract("file", r"hyp__([^/]+)__([^/]+)\.json(?:/[^/]*)?$", k)
    return maps.select(name(1).alias("model"), name(2).alias("test_set"), F.col("key").alias("audio_filepath"), F.col("value").alias("hyp"))


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """A stored edit table; fails when a required column is missing."""
    return require(spark.read.parquet(path), EDIT_COLUMNS, path)


def read_routing(spark: SparkSession, path: str, experts: int | None = None) -> DataFrame:
    """A wide routing CSV with expert_0_prob ... as one array column, in numeric order of the experts."""
    return routing_from_wide(spark.read.option("header", True).csv(path), path, experts)


def routing_from_wide(wide: DataFrame, what: str = "the table", experts: int | None = None) -> DataFrame:
    require(wide, ROUTING_COLUMNS, what)
    prob = sorted((c for c in wide.columns if c.startswith("expert_") and c.endswith("_prob") and c[7:-5].isdigit()), key=lambda c: int(c[7:-5]))
    if not prob or experts not in (None, len(prob)):
        raise ValueError(f"{what} has {len(prob)} expert columns")
    rest = [c for c in wide.columns if c not in prob]
    kinds = {"layer_idx": "int", "duration_sec": "double", "router_entropy": "double", "top1_expert": "int", "top2_expert": "int"}
    return wide.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in rest], F.array(*[F.col(c).cast("double") for c in prob]).alias("probs"))


def routing_to_wide(routing: DataFrame, experts: int) -> DataFrame:
    return routing.select(*[c for c in routing.columns if c != "probs"], *[F.get("probs", i).alias(f"expert_{i}_prob") for i in range(experts)])


def write_results_json(results: DataFrame, path: str, experiment: str) -> None:
    """K1: one object per model with its list of set results."""
    nested = results.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("test_set", "utterances", "words", "errors", "wer"))).alias("results"))  # as many as there are sets
    nested.select(F.lit(experiment).alias("experiment"), "model", "results").write.mode("overwrite").json(path)


#: Parts of a table that a task writes side by side; Spark sorts the rows of a task where there are more.
WRITERS = 8


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: bool = False, kind: str = "parquet") -> None:
    """K2, K3: write once (keep: leave what is there), as Parquet or CSV with a header. A few parts are written side by side, so that no task sorts its rows by them."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, WRITERS)
    try:
        w = df.write.mode("ignore" if keep else "overwrite").partitionBy(*partition_by or [])
        w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)
    finally:
        conf.set(name, before)


#: Hypotheses of one JSON map; a set of more of them is written as several.
MAP_ROWS = 20_000


def hypothesis_maps(hyps: DataFrame) -> DataFrame:
    """(file, value): the JSON maps hyp__MODEL__SET.json of hypotheses, none of them larger than about MAP_ROWS."""
    sizes = hyps.groupBy("model", "test_set").agg(F.ceil(F.count(F.lit(1)) / MAP_ROWS).alias("_n"))
    # A row per map name, which is sent to the rows: dealt by name, all hypotheses of a set would meet in one task.
    dealt = hyps.join(F.broadcast(sizes), ["model", "test_set"]).withColumn("_part", F.pmod(F.xxhash64("audio_filepath"), F.col("_n")))
    maps = dealt.groupBy("model", "test_set", "_part").agg(F.map_from_entries(F.collect_list(F.struct("audio_filepath", F.coalesce("hyp", F.lit(""))))).alias("m"))
    return maps.select(F.concat(F.lit("hyp__"), "model", F.lit("__"), "test_set", F.lit(".json")).alias("file"), F.to_json("m").alias("value"))


def write_hypotheses(hyps: DataFrame, path: str) -> None:
    """K3: (model, test_set, audio_filepath, hyp) as folders hyp__MODEL__SET.json of JSON maps."""
    hypothesis_maps(hyps).write.partitionBy("file").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def error_rows(models: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """K5: every model of the registry; those without results carry null metrics and their error."""
    return models.join(results, "model", "left").join(errors.select("model", "error"), "model", "left")


def union_groups(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the schemas."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_utterances(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in an order, so that the choice does not follow partitions."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(df.columns)
