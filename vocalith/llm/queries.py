"""The registered queries of this subpackage and their SQL. Each applies its operator to whole tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, external_shuffle, filter_audit, line_dedup, ngram_join, packing, secret_scan, stream_dedup, structure_repair, suffix_tree, token_counts, toxicity
from .common import crc_fold, fresh_path, save, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=rules)
    base = F.filter("secrets", lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(base, rules).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("secrets"), rules).alias("spans"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "shards")
    external_shuffle.write_shards(external_shuffle.external_shuffle(table(spark, sf_dir, "documents"), 24), path)
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(path).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.dedup_files(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


#: The conversation that the contract adds.
ADDED_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(save(chat_format.format_turns(turns.unionByName(added)), "chat"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.histogram(table(spark, sf_dir, "documents"), group="lang"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=lambda c: crc_fold(F.col(c), 5) != 0)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair(structure_repair.damage(table(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sharding": op2_sharding,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_structure_repair": op11_structure_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}

# --- the same in SQL, where SQL can state it. Trained scores, tokenizers and random orders (op2, op4, op5, op8, op9) and the
# pipeline are tested against plain versions in tests/llm.


def _low(c: str) -> str:
    return f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_SQL_RULES = [
    ("assign", rf"""({_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]


def _secrets_sql() -> str:
    found = " UNION ALL ".join(
        f"SELECT row, {k} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {g})) AS part, "
        f"unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) AS gap, unnest(range(len(regexp_extract_all(t, '{p}')))) AS nth FROM d"
        for k, (kind, p, g, _) in enumerate(_SQL_RULES)
    )
    least = "CASE rank " + " ".join(f"WHEN {k} THEN {x[3]}" for k, x in enumerate(_SQL_RULES)) + " END"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, rank ORDER BY nth)::BIGINT AS last FROM f),
ok AS (SELECT row, rank, last - length(m) AS start, kind || ':' || (last - length(m)) || ':' || last AS span FROM s WHERE length(part) >= {least}),
a AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM ok GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"""


_MARK = r"regexp_replace({0}, '([\\#<{1}])', '\\\1', 'g')"

#: The CRC-32 of an ASCII string, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Every order of the five filters, its steps, the filter of the step, and the filters before it.
_ORDERS = ", ".join(f"('{''.join(o)}', {k + 1}, {1 << 'ABCDE'.index(f)}, {sum(1 << 'ABCDE'.index(x) for x in o[:k])})" for o in itertools.permutations("ABCDE") for k, f in enumerate(o))
#: The repair program over a list of rows: per state 0 to 3 the cost and the edits so far; p is a state, q offers.
_EDIT = "STRUCT(c BIGINT, a VARCHAR)"
_FAR = f"{{'c': 1000000000, 'a': ''}}::{_EDIT}"


def _add(p: str, cost: str, edit: str) -> str:
    return f"{{'c': ({p}).c + {cost}, 'a': ({p}).a || '{edit}'}}::{_EDIT}"


def _least(*offers: str) -> str:
    return f"list_sort([{', '.join(offers)}])[1]"


def _repair_sql() -> str:
    keep = lambda p, initial: f"CASE WHEN x.i = '{initial}' AND NOT x.must THEN {_add(p, 'x.late', 'K')} ELSE {_FAR} END"
    recast = lambda p: f"CASE WHEN x.must THEN {_FAR} ELSE {_add(p, 'x.late + 3', 'R')} END"
    drop = lambda p: _add(p, "4", "D")
    users = [f for p in ("s.p0", "s.p1", "s.p3") for f in (keep(p, "u"), recast(p))]
    row = f"{{'p0': {drop('s.p0')}, 'p1': {_least(drop('s.p1'), keep('s.p0', 's'))}, 'p2': {_least(drop('s.p2'), *users)}, 'p3': {_least(drop('s.p3'), keep('s.p2', 'a'), recast('s.p2'))}}}"
    user = f"list_transform([{row}], lambda y: {{'p0': y.p0, 'p1': y.p1, 'p2': {_least('y.p2', *[_add(f'y.{p}', '3', 'I') for p in ('p0', 'p1', 'p3')])}, 'p3': y.p3}})[1]"
    both = f"list_transform([{user}], lambda z: {{'p0': z.p0, 'p1': z.p1, 'p2': z.p2, 'p3': {_least('z.p3', _add('z.p2', '3', 'I'))}}})[1]"
    begin = f"{{'p0': {{'c': 0, 'a': ''}}::{_EDIT}, 'p1': {_FAR}, 'p2': {{'c': 3, 'a': 'I'}}::{_EDIT}, 'p3': {{'c': 6, 'a': 'II'}}::{_EDIT}}}"
    return rf"""WITH h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32 % 20 AS how FROM (SELECT *, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} AS crc32 FROM conversations)),
w AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t FROM w),
f AS (SELECT *, t = '' AS blank, t <> '' AND again AS duplicate, t <> '' AND NOT again AND NOT regexp_matches(t, '[.!?]$') AS truncated, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS met FROM o),
g AS (SELECT conv_id, list({{'i': role[1], 'must': blank OR duplicate, 'late': truncated::INT * 3, 'role': role, 'text': text}} ORDER BY k) AS l, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (met NOT IN ('su', 'ua', 'au')) AS illegal,
 coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY 1),
d AS (SELECT *, list_reduce(list_prepend({{'i': '', 'must': true, 'late': 0, 's': {begin}}}, list_transform(l, lambda r: {{'i': r.i, 'must': r.must, 'late': r.late, 's': {begin}}})), lambda acc, x: list_transform([acc.s], lambda s: {{'i': '', 'must': true, 'late': 0, 's': {both}}})[1]).s AS s FROM g),
b AS (SELECT *, unnest([{_least('s.p0', 's.p3')}]) AS won FROM d),
e AS (SELECT conv_id, pos, won.a[pos] AS edit, l[length(replace(won.a[:pos], 'I', ''))] AS row, length(replace(won.a[:pos], 'D', '')) AS place, starts_with(ltrim(won.a, 'D'), 'K') AND l[length(won.a) - length(ltrim(won.a, 'D')) + 1].i = 's' AS led FROM (SELECT *, unnest(range(1, length(won.a) + 1))::INT AS pos FROM b)),
r AS (SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN row.role ELSE CASE WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE edit WHEN 'I' THEN '' ELSE row.text END, chr(10) ORDER BY pos)) AS sha FROM e WHERE edit <> 'D' GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(won.c, 0)::BIGINT AS cost, coalesce(won.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id"""


ORACLES: dict[str, str] = {
    "op11_structure_repair": _repair_sql(),
    "op12_filter_audit": rf"""WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
d AS (SELECT coalesce(source, '') AS part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, coalesce(text, '') AS t, {_WORDS} AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copied FROM documents LEFT JOIN l USING (doc_id)),
m AS (SELECT part, good, toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * copied::INT AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2), o(filter_order, step, f, before) AS (VALUES {_ORDERS}),
s AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (mask & (before | f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & before > 0 AND mask & f > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
 coalesce(sum(good) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & f > 0), 0)::BIGINT AS toxic_lost FROM c, o GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM s""",
    "op13_line_dedup": rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT row, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, {_low(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM x),
r AS (SELECT key, max(doc_id) AS keep FROM (SELECT DISTINCT row, doc_id, key FROM k WHERE length(key) >= 40) GROUP BY 1 HAVING count(*) >= 5)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND doc_id IS DISTINCT FROM keep) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.key IS NULL OR doc_id IS NOT DISTINCT FROM keep), '')) AS kept_sha256 FROM k LEFT JOIN r USING (key) GROUP BY row""",
    "op1_secret_scan": _secrets_sql(),
    "op3_chat_format": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '### ' || {_MARK.format("role", ":" + chr(10))} || ': ' || {_MARK.format("text", "")} || ' </turn>' || chr(10) AS segment FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, segment)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, segment) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(segment))::BIGINT AS formatted_chars FROM e GROUP BY 1""",
    "op6_ngram_join": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_low("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT row, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT row, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.row AS x, b.row AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.row < b.row GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.row = x JOIN n ny ON ny.row = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT row AS root, row FROM d UNION SELECT r.root, e.y FROM r JOIN e ON r.row = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (row) JOIN (SELECT r.row, min(o.doc_id) AS component_id FROM r JOIN d o ON o.row = r.root GROUP BY 1) c USING (row)""",
    "op7_exact_dedup": f"SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256({_low('text')}) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY {_low('text')})",
    "op10_decontaminate": f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_low("text")}, '[0-9a-z\x80-\U0010ffff]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_low("text")}, '[0-9a-z\x80-\U0010ffff]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM g),
h AS (SELECT row, i, n.n, array_to_string(w[i:i + n.n - 1], ' ') AS gram FROM d, n, LATERAL (SELECT unnest(range(1, len(w) - n.n + 2)) AS i)),
m AS (SELECT row, i, g.n, item FROM h JOIN g ON h.n = g.n AND h.gram = g.gram),
hit AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM m) GROUP BY 1),
it AS (SELECT row, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (row) LEFT JOIN it USING (row)""",
}
