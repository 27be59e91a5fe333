"""How the given tables stand in for manifests, hypotheses, edits and routing tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.functions import text as T
from vocalith.operators import align, resample, routing

MODELS = {"dense": (7, 11), "moe": (5, 13), "moe_lb": (9, 6)}  # model -> every which word is dropped, replaced
LAYERS, EXPERTS, TOP_K = 8, 8, 2
#: A recording is cut into utterances of so many words, the last one shorter; every word is in one of them.
UTTERANCE_WORDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as utterances: source is the speaker, quality the age group (null where there is no label)."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    age = F.when(F.col("quality") == 0, "child").when(F.col("quality") == 1, "adult")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.select("doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("speaker"), age.alias("age_group"), (F.col("n_chars") / 15.0).alias("duration"), path().alias("audio_filepath"))


def path() -> Column:
    return F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("-audio/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".wav"))


#: Bytes of a table's files that a task is given where the rows are dealt.
SPREAD_BYTES = 1 << 24


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than there are cores dealt over tasks, as many as its size asks for and one per core at least; a table of many files stays as it is read."""
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    size = sum((at := path(f)).getFileSystem(conf).getFileStatus(at).getLen() for f in files)
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)))


def reference(c: Column) -> Column:
    """The words of the basic normal form, which is what was said; they stand one space apart."""
    return F.array_remove(F.split(T.norm_basic(c), " "), "")


def corrupted(ref: Column, drop: int, swap: int) -> Column:
    swapped = F.transform(ref, lambda x, i: F.when((i + 1) % swap == 0, "zz").otherwise(x))
    return F.filter(swapped, lambda x, i: (i + 1) % drop != 0)


def corrupted_utterance(ref: Column, drop: int, swap: int) -> Column:
    """corrupted() of at most UTTERANCE_WORDS words, from the places that stay; a replaced one is no place."""
    places = [-1 if (i + 1) % swap == 0 else i for i in range(UTTERANCE_WORDS) if (i + 1) % drop]
    kept = F.slice(F.array(*map(F.lit, places)), F.lit(1), F.size(ref) - F.floor(F.size(ref) / drop).cast("int"))
    return F.transform(kept, lambda i: F.coalesce(F.get(ref, i), F.lit("zz")))


def _said(spark: SparkSession, sf_dir: str, as_sql: bool = False) -> DataFrame:
    """Recordings with their words rw. as_sql: where the SQL's engine reads a text otherwise than Python and Java do, as it does: İ is i in lower case, and a null text has null words, not none."""
    w = reference(F.replace(F.col("text"), F.lit("İ"), F.lit("i")) if as_sql else F.col("text"))
    return spread(utterances(spark, sf_dir)).withColumn("rw", F.when(F.col("text").isNotNull(), w) if as_sql else w).drop("text", "duration")


def _cut(u: DataFrame) -> DataFrame:
    """Recordings as utterances, numbered by seg."""
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("rw") - 1) / UTTERANCE_WORDS).cast("int")))
    u = u.select("*", F.posexplode(F.transform(cuts, lambda i: F.slice("rw", i * UTTERANCE_WORDS + 1, F.lit(UTTERANCE_WORDS)))).alias("seg", "_part")).withColumn("rw", F.col("_part")).drop("_part")
    return u.withColumn("audio_filepath", F.concat(F.substring_index("audio_filepath", ".wav", 1), F.lit("_"), F.col("seg").cast("string"), F.lit(".wav")))


def pairs(spark: SparkSession, sf_dir: str, whole: bool = False, as_sql: bool = False) -> DataFrame:
    """(model, utterance columns, seg, ref, hyp) with word arrays rw and hw; whole: one pair per recording, not per utterance."""
    said = _said(spark, sf_dir, as_sql)
    u, damage = (said, corrupted) if whole else (_cut(said), corrupted_utterance)
    models = F.array(*[F.struct(F.lit(m).alias("model"), damage(F.col("rw"), *x).alias("hw")) for m, x in MODELS.items()])
    p = u.withColumn("_m", F.explode(models)).select("*", "_m.model", "_m.hw").drop("_m")
    return p.withColumns({"ref": F.array_join("rw", " "), "hyp": F.array_join("hw", " ")})


def edits(spark: SparkSession, sf_dir: str, as_sql: bool = False) -> DataFrame:
    """The edit table of all utterances with errors only (A1); the models' hypotheses are aligned beside one copy of the reference. Null words have no error."""
    u = _cut(_said(spark, sf_dir, as_sql)).select("doc_id", "seg", "language", "speaker", "age_group", "rw")
    e = u.withColumns({f"_{m}": F.coalesce(align.word_edit_distance(F.col("rw"), corrupted_utterance(F.col("rw"), *x)), F.lit(0)) for m, x in MODELS.items()})
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_{m}").alias("errors")) for m in MODELS]))
    return e.withColumn("words", F.when(F.col("rw").isNotNull(), F.size("rw"))).select("doc_id", "seg", "language", "speaker", "age_group", "words", each).select("model", "doc_id", "seg", "language", "speaker", "age_group", "words", "errors")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as router logits: eight layers of eight experts; vec_id is the utterance, the label its group."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer_idx"), "embedding")
    logits = F.slice("embedding", F.col("layer_idx") * EXPERTS + 1, F.lit(EXPERTS))
    return e.select("vec_id", "label", "layer_idx", logits.alias("logits"))


def routing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    language = F.get(F.array(*map(F.lit, ("en", "de", "nl", "pl"))), F.col("label") % 4)
    return f.select(
        F.lit("multi").alias("model"), F.col("vec_id").alias("utterance_id"), F.when(F.col("label") % 3 == 0, "child").otherwise("adult").alias("age_group"), language.alias("language"),
        F.concat(F.lit("set"), F.col("label").cast("string")).alias("dataset_source"), "layer_idx", (F.col("vec_id") % 30 + 1).cast("double").alias("duration_sec"), routing.softmax(F.col("logits")).alias("probs"),
    )


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sources, regions as languages, order totals as hours."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    hours = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.sum(F.round(F.col("o_totalprice"), 0).cast("long")).alias("hours"))
    j = hours.join(n, hours.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_name").alias("source"), F.col("r_name").alias("language"), F.col("hours").cast("double").alias("hours"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey").cast("double")).alias("weight"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark; their first three letters are the canonical form."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(T.words(T.norm_basic(F.col("text")))).alias("token")).distinct()
    return w.select("token", F.substring("token", 1, 3).alias("canonical"))


def basic_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}),'<[^>]+>',' ','g'),'\+[^+]*\+',' ','g'),'[^a-z0-9''\s]',' ','g'),'\s+',' ','g'))"


def number_sql(n: str) -> str:
    """0 to 9999 in words, larger numbers in digits."""
    ones, tens = (f"{[w for w in ws]}" for ws in (T.ONES, T.TENS))
    small = lambda x: f"(CASE WHEN {x} < 20 THEN {ones}[{x} + 1] ELSE {tens}[{x} // 10 - 1] || CASE WHEN {x} % 10 = 0 THEN '' ELSE ' ' || {ones}[{x} % 10 + 1] END END)"
    over = lambda x, base, name, rest: f"({ones}[{x} // {base} + 1] || ' {name}' || CASE WHEN {x} % {base} = 0 THEN '' ELSE ' ' || {rest(f'({x} % {base})')} END)"
    mid = lambda x: f"(CASE WHEN {x} < 100 THEN {small(x)} ELSE {over(x, 100, 'hundred', small)} END)"
    return f"(CASE WHEN {n} < 1000 THEN {mid(n)} WHEN {n} < 10000 THEN {over(n, 1000, 'thousand', mid)} ELSE {n}::VARCHAR END)"


def basic_num_sql(c: str) -> str:
    marked = rf"regexp_replace(regexp_replace(lower({c}),'<[^>]+>',' ','g'),'\+[^+]*\+',' ','g')"
    runs = rf"regexp_extract_all({marked}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+')"
    said = f"CASE WHEN regexp_full_match(x, '[0-9]+') THEN CASE WHEN length(ltrim(x, '0')) <= 4 THEN {number_sql('x::INT')} WHEN length(x) > 0 THEN ltrim(x, '0') END ELSE x END"
    return rf"trim(regexp_replace(regexp_replace(array_to_string(list_transform({runs}, lambda x: {said}), ''),'[^a-z0-9''\s]',' ','g'),'\s+',' ','g'))"


def words_sql(c: str) -> str:
    return f"list_filter(string_split({c},' '), lambda x: x <> '')"


UTT = """utt AS (SELECT d.doc_id, d.text, d.lang AS language, d.source AS speaker, CASE l.quality WHEN 0 THEN 'child' WHEN 1 THEN 'adult' END AS age_group,
 d.n_chars / 15.0 AS duration, '/data/' || d.source || '/' || d.doc_id || '-audio/' || d.lang || '_' || d.doc_id || '.wav' AS audio_filepath
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""
_M = ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in MODELS.items())
PAIRS = f"""{UTT}, said AS (SELECT * EXCLUDE (text, duration), {words_sql(basic_sql("text"))} AS w FROM utt),
ref0 AS (SELECT * EXCLUDE (w, audio_filepath), replace(audio_filepath, '.wav', '_' || seg || '.wav') AS audio_filepath, w[seg * {UTTERANCE_WORDS} + 1:seg * {UTTERANCE_WORDS} + {UTTERANCE_WORDS}] AS rw
 FROM (SELECT *, unnest(range(greatest(1, (len(w) + {UTTERANCE_WORDS - 1}) // {UTTERANCE_WORDS})))::INT AS seg FROM said)),
m(model, dropped, swapped) AS (VALUES {_M}),
pairs AS (SELECT r.*, model, list_transform(list_filter(list_zip(list_transform(rw, lambda x, i: CASE WHEN i % swapped = 0 THEN 'zz' ELSE x END), range(1, len(rw) + 1)), lambda x: x[2] % dropped <> 0), lambda x: x[1]) AS hw FROM ref0 r, m)"""
EDITS = f"""{PAIRS}, coded AS (SELECT *, list_distinct(list_concat(rw, hw)) AS pool FROM pairs),
edits AS (SELECT model, doc_id, seg, language, speaker, age_group, len(rw) AS words,
 levenshtein(coalesce(array_to_string(list_transform(rw, lambda x: chr(33 + list_position(pool, x)::INT)), ''), ''), coalesce(array_to_string(list_transform(hw, lambda x: chr(33 + list_position(pool, x)::INT)), ''), '')) AS errors FROM coded)"""
_CELL = "STRUCT(c INT, o VARCHAR)"
_STEP = """CASE WHEN x.k - i > len(hw) THEN NULL WHEN i = 0 THEN {'c': x.k::INT, 'o': repeat('I', x.k)} WHEN i = x.k THEN {'c': x.k::INT, 'o': repeat('D', x.k)}
 WHEN rw[i] = hw[x.k - i] THEN {'c': a.p2[i].c, 'o': a.p2[i].o || 'E'} WHEN a.p2[i].c <= least(a.p1[i].c, a.p1[i + 1].c) THEN {'c': a.p2[i].c + 1, 'o': a.p2[i].o || 'S'}
 WHEN a.p1[i].c <= a.p1[i + 1].c THEN {'c': a.p1[i].c + 1, 'o': a.p1[i].o || 'D'} ELSE {'c': a.p1[i + 1].c + 1, 'o': a.p1[i + 1].o || 'I'} END"""
#: The edit matrix diagonal by diagonal: a cell is its cost and its ops; k counts the diagonals, p1 and p2 are the last two.
ALIGNED = (f"""aligned AS MATERIALIZED (SELECT *, list_reduce(list_prepend({{'k': 0::BIGINT, 'p2': []::{_CELL}[], 'p1': [{{'c': 0, 'o': ''}}]::{_CELL}[]}}, list_transform(range(1, len(rw) + len(hw) + 1), lambda k: {{'k': k, 'p2': []::{_CELL}[], 'p1': []::{_CELL}[]}})),
 lambda a, x: {{'k': x.k, 'p2': a.p1, 'p1': list_transform(range(0, least(len(rw), x.k) + 1), lambda i: {_STEP})}}).p1[len(rw) + 1].o AS ops FROM {{pairs}}),
sdi AS (SELECT *, len(rw) AS words, length(replace(ops, 'S', 'SS')) - length(ops) AS substitutions, length(replace(ops, 'D', 'DD')) - length(ops) AS deletions, length(replace(ops, 'I', 'II')) - length(ops) AS insertions FROM aligned),
ops AS (SELECT * EXCLUDE (kind), CASE kind WHEN 'E' THEN 'equal' WHEN 'S' THEN 'sub' WHEN 'D' THEN 'del' ELSE 'ins' END AS op, CASE WHEN kind <> 'I' THEN rw[pos + 1 - (length(replace(ops[1:pos + 1], 'I', 'II')) - pos - 1)] END AS ref_word,
 CASE WHEN kind <> 'D' THEN hw[pos + 1 - (length(replace(ops[1:pos + 1], 'D', 'DD')) - pos - 1)] END AS hyp_word FROM (SELECT *, unnest(range(length(ops)))::INT AS pos, unnest(string_split(ops, '')) AS kind FROM aligned WHERE ops <> ''))""").replace("{", "{{").replace("}", "}}").replace("{{pairs}}", "{pairs}")
ROUTING = """logits AS (SELECT vec_id, label, l.layer_idx, list_transform(embedding[(l.layer_idx * 8 + 1):(l.layer_idx * 8 + 8)], lambda x: x::DOUBLE) AS logits FROM embeddings, (SELECT unnest(range(8))::INT AS layer_idx) l),
soft AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM logits),
routing AS (SELECT 'multi' AS model, vec_id AS utterance_id, CASE WHEN label % 3 = 0 THEN 'child' ELSE 'adult' END AS age_group, ['en','de','nl','pl'][label % 4 + 1] AS language,
 'set' || label AS dataset_source, layer_idx, (vec_id % 30 + 1)::DOUBLE AS duration_sec, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM soft),
long AS (SELECT * EXCLUDE (probs), unnest(range(8))::INT AS expert, unnest(probs) AS p FROM routing)"""


def picks_sql(name: str, seed: str, groups: str, replicates: int, keys: str) -> str:
    """Draws (keys, replicate, ix) of n from n per group and replicate; groups is a table of keys and n, seed an expression over it and the replicate."""
    mixed = lambda a, z: f"xor({a}, {a} >> 16) AS {z}1, ({z}1 * {resample.MIX_1}) % 4294967296 AS {z}2, xor({z}2, {z}2 >> 13) AS {z}3, ({z}3 * {resample.MIX_2}) % 4294967296 AS {z}4, xor({z}4, {z}4 >> 16) AS {z}5"
    return f"""{name}_h AS (SELECT {keys}, n, replicate, md5({seed}) AS h FROM {groups}, (SELECT unnest(range({replicates})) AS replicate)),
{name}_s AS (SELECT {keys}, n, replicate, ('0x' || substr(h, 1, 8))::UBIGINT AS a, ('0x' || substr(h, 9, 8))::UBIGINT AS b, unnest(range(n))::UBIGINT AS slot FROM {name}_h),
{name}_d AS (SELECT {keys}, replicate, (a + slot * {resample.STEP}) % 4294967296 AS x, {mixed("x", "y")}, xor(y5, b) AS z, {mixed("z", "w")}, (w5 % n)::BIGINT AS ix FROM {name}_s)"""


MIXTURE = """mixture AS (SELECT n_name AS source, r_name AS language, sum(round(o_totalprice, 0)::BIGINT)::DOUBLE AS hours, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey::DOUBLE END AS weight
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name, n_nationkey)"""
DICT = f"""dict AS (SELECT DISTINCT token, substr(token, 1, 3) AS canonical FROM (SELECT unnest({words_sql(basic_sql("text"))}) AS token FROM benchmark))"""
