import hashlib
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vocalith.llm import chat_format, decontaminate, external_shuffle, packing, queries, secret_scan, stream_dedup, token_counts, toxicity
from vocalith.llm.encode import tokenizer_path

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard_ string"
LONG = "Word and more " * 30_000
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "Aa bB"), (5, "aA bb"), (6, LONG), (7, LONG.upper()), (8, "É é"), (8, "É é"), (None, "x"), (None, None), (9, "tÖken 😀")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "k") for d, t in rows], SCHEMA)


def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# --- secret scan


def test_trigram_queries():
    q = secret_scan.trigram_query(secret_scan.BASE_RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in q and frozenset({"pas", "ass", "ssw", "swd"}) in q and len(q) == 6
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secret_scan.trigram_query("[0-9a-f]{16,}") == []


def test_secret_scan_query(spark, sf):
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, sf).collect()}
    rows = docs(spark, sf)
    assert len(got) == len(rows)
    for d, t in rows:
        s = brute.secrets(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == x[1] for x in s) for k in range(3))
        assert got[d].base_sha256 == brute.sha(text)


def test_secret_scan_edges(spark):
    rng = random.Random(5)
    bits = ["token", "PassWord", "api_key", "APIKEY", "ſecret", "=", ":", " ", '"', "'", "abcdefghijkl", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "é", "😀", "\n", "secret="]
    rows = EDGE + [(100 + i, "".join(rng.choices(bits, k=rng.randint(1, 25)))) for i in range(300)]
    rows += [(99, "token=" + "a" * 20), (99, "nothing")]
    found = secret_scan.scan_secrets(frame(spark, rows), rules=secret_scan.BASE_RULES)
    assert found.columns[:-1] == frame(spark, []).columns
    got = sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.secrets]) for r in found.collect())
    assert got == sorted((str(d), t or "", brute.secrets(t)) for d, t in rows)
    assert secret_scan.scan_secrets(frame(spark, [])).count() == 0


def test_more_rules(spark):
    text = "x ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY----- AIza" + "b" * 35
    got = secret_scan.scan_secrets(frame(spark, [(1, text)])).first().secrets
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    assert {"github", "pem", "google"} <= {rules[s["rank"]].kind for s in got}


# --- sharding


@pytest.mark.parametrize("bucket", [1 << 10, 1 << 20])
def test_shards(spark, bucket):
    rows = EDGE + [(1000 + i, "t" * (i % 50)) for i in range(500)] + [(5000, "same")] * 300
    out = external_shuffle.external_shuffle(frame(spark, rows), 24, bucket_bytes=bucket)
    got = out.collect()
    assert out.columns == frame(spark, []).columns + ["shard", "slot"]
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(d), t or "") for d, t in rows)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(24)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert [(r.doc_id, r.shard, r.slot) for r in external_shuffle.external_shuffle(frame(spark, rows), 24, bucket_bytes=bucket).collect()] == [(r.doc_id, r.shard, r.slot) for r in got]
    if bucket == 1 << 20:  # order is mixed: neighbours seldom stay neighbours
        ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id and 1000 <= r.doc_id < 1500]
        assert sum(b - a == 1 for a, b in zip(ids, ids[1:])) < 20


def test_shards_empty_and_few(spark):
    assert external_shuffle.external_shuffle(frame(spark, []), 24).count() == 0
    assert len({(r.shard, r.slot) for r in external_shuffle.external_shuffle(frame(spark, EDGE[:5]), 24).collect()}) == 5


def test_sharding_query(spark, sf):
    got = {r.doc_id: r for r in queries.op2_sharding(spark, sf).collect()}
    for d, t in docs(spark, sf):
        assert (got[d].size, got[d].text_crc32, got[d].law) == (len(t.encode()) + 8, brute.crc(t.encode()), "rows")
    by = {}
    for r in got.values():
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in by.values()]
    assert sorted(by) == list(range(24)) and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())


# --- chat


def test_chat_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_chat(turns + queries.ADDED_CONVERSATION, queries.op3_chat_format(spark, sf).collect())


def check_chat(turns, got):
    by = {}
    mark = lambda s: re.sub(r"[\\#<]", lambda m: "\\" + m[0], s or "")
    for t in sorted(turns, key=lambda t: (t[0] is not None, t[0], t[1], t[2] or "", mark(t[3]) + " </turn>")):
        by.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    assert len(got) == len(by)
    for r in got:
        mine = by[r.conv_id]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.turns_sha256 == brute.sha("".join(f"{a}\n{b}\n" for a, b in mine))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        esc = lambda s, x: sum(s.count(c) for c in x)
        assert r.formatted_chars == sum(4 + len(a) + esc(a, "\\#<:\n") + 2 + len(b) + esc(b, "\\#<") + 9 for a, b in mine)


def test_chat_edges(spark):
    rng = random.Random(3)
    bits = ["\\", "#", "### ", "</turn>", "\n", ": ", "é😀", "a", "### assistant: ", " </turn>\n"]
    turns = [(rng.randint(1, 9), rng.randint(0, 5), rng.choice(["user", "assistant", "a: b#\n", None]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))])) for _ in range(200)]
    turns += [(50, 1, "assistant", LONG), (51, 0, "user", "x"), (51, 0, "user", "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    check_chat(turns, chat_format.read_back(chat_format.format_turns(df)).collect())
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


# --- packing, token counts


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_packing(rows, got):
    want = {}
    for (d, _), ids in zip(rows, encode([t for _, t in rows])):
        ids = [*ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want.setdefault((d, p // 2048, p, len(part), brute.crc(np.array(part, "<u4").tobytes())), []).append(1)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((str(k[0]), *k[1:]) for k, v in want.items() for _ in v)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by), sum(r.length for r in got)


def test_packing_query(spark, sf):
    bins, tokens = check_packing(docs(spark, sf), queries.op4_packing(spark, sf).collect())
    assert bins <= -(-tokens // 2048) * 1.05 + 1


def test_packing_edges(spark):
    rows = EDGE + [(20, "<|endoftext|> a\u0301 don't\x85x\u00a0y 1234 ..."), (21, "A" * 5000), (22, "\x00\x01 \u2003z")]
    check_packing(rows, packing.pack(frame(spark, rows)).collect())
    one = packing.pack(frame(spark, rows[:1]), with_ids=True).first()
    assert one.ids == b"\0\0\0\0"
    assert packing.pack(frame(spark, [])).count() == 0


def test_plan_is_tight():
    rng = random.Random(1)
    for cap, hist in ((100, {50: 7, 51: 3, 34: 9, 33: 5, 1: 2}), (2048, {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(600)}), (9, {3: 10}), (10, {10: 4})):
        free, placed = {}, {}
        for length, rank, n, per, at, off in packing.plan(dict(hist), cap):
            assert rank == placed.get(length, 0)
            placed[length] = rank + n
            for i in range(n):
                free.setdefault(at + i // per, []).append((off + i % per * length, length))
        assert placed == hist
        for v in free.values():
            v.sort()
            assert all(a + b == c for (a, b), (c, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(v[-1]) <= cap
        lower = max(-(-sum(k * v for k, v in hist.items()) // cap), sum(v for k, v in hist.items() if 2 * k > cap))
        assert len(free) <= lower * 1.1 + 1


def test_token_counts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()
    by = {}
    for r, ids in zip(rows, encode([r.text for r in rows])):
        by.setdefault(r.lang, []).append(len(ids))
    got = queries.op5_token_counts(spark, sf).collect()
    assert len(got) == sum(len(set(v)) for v in by.values())
    for r in got:
        v, limit = by[r.grp], r.context_limit
        assert (r.n_docs, r.docs_within, r.docs_cut) == (v.count(limit), sum(x <= limit for x in v), sum(x > limit for x in v))
        assert (r.tokens_within, r.tokens_total, r.tokens_kept) == (sum(x for x in v if x <= limit), sum(v), sum(min(x, limit) for x in v))
        assert abs(r.quantile - sum(x <= limit for x in v) / len(v)) < 1e-12


def test_token_counts_edges(spark):
    out = token_counts.limits(token_counts.histogram(frame(spark, EDGE))).collect()
    assert sum(r.n_docs for r in out) == len(EDGE) and min(r.context_limit for r in out) == 0
    assert token_counts.limits(token_counts.histogram(frame(spark, []))).count() == 0


# --- exact dedup


def check_dedup(rows, got):
    by = {}
    for d, t in rows:
        by.setdefault(brute.low(t), []).append(d)
    want = []
    for t, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(str(d), str(keep), len(ids), d == keep, brute.sha(t)) for d in ids]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.digest) for r in got) == sorted(want)


def test_dedup(spark, sf):
    rows = docs(spark, sf)
    check_dedup(rows, stream_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    check_dedup(rows + EDGE, stream_dedup.exact_dedup(frame(spark, rows + EDGE)).collect())
    assert stream_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_dedup_checks_bytes(spark, sf):
    """With a digest of 8 values every group holds several texts, and only the byte check keeps them apart."""
    rows = docs(spark, sf)[:200] + EDGE
    weak = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(8)).cast("string")
    got = [r.asDict() for r in stream_dedup.exact_dedup(frame(spark, rows), digest=weak).collect()]
    by = {}
    for d, t in rows:
        by.setdefault(brute.low(t), []).append(d)
    want = sorted((str(d), str(max((i for i in ids if i is not None), default=None)), len(ids)) for ids in by.values() for d in ids)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want


def test_dedup_state_outlives_a_run(spark, tmp_path):
    """Files one by one; then more files on the state of the first run, which reads the new ones only; then nothing new."""
    path, state = str(tmp_path / "docs"), "file://" + str(tmp_path / "state")
    rows = [(10 * k + i, ["Same", "same", f"own {k} {i}", None][i]) for k in range(5) for i in range(4)]

    def add(some):
        for i in range(0, len(some), 4):
            spark.createDataFrame(some[i : i + 4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)

    add(rows[:12])
    check_dedup(rows[:12], stream_dedup.dedup_files(spark, path, state=state, files_per_batch=1).collect())
    epochs = lambda: sorted(x.name for x in (tmp_path / "state" / "checkpoint" / "commits").iterdir() if not x.name.startswith("."))
    assert len(epochs()) == 3
    add(rows[12:])
    check_dedup(rows, stream_dedup.dedup_files(spark, path, state=state, files_per_batch=1).collect())
    assert len(epochs()) == 5
    check_dedup(rows, stream_dedup.dedup_files(spark, path, state=state).collect())
    assert len(epochs()) == 5
    kept = spark.read.parquet(str(tmp_path / "state" / "groups")).where("group_size = 10").select("keep.*").first()
    there = spark.read.parquet(kept.file).withColumn("at", F.col("_metadata.row_index")).where(F.col("at") == kept.row).first()
    assert (there.doc_id, there.text) == (41, "same")  # the locator leads to the row that stays


def test_dedup_reads_files_of_any_age(spark, tmp_path):
    """A file that is older than what the state has seen, in a folder whose name looks like a pattern, with a column `_metadata`."""
    path, state = tmp_path / "docs [a]*{b}", "file://" + str(tmp_path / "state")

    def add(rows, days):
        before = set(path.glob("*.parquet")) if path.exists() else set()
        spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, _metadata string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/new")
        path.mkdir(exist_ok=True)
        for f in (tmp_path / "new").glob("part-*.parquet"):
            if path / f.name not in before:
                f.rename(path / f.name)
                os.utime(path / f.name, (time.time() - 86_400 * days,) * 2)

    first, older = [(1, "x"), (2, "X"), (3, "y")], [(4, "x"), (5, "new")]
    add(first, 0)
    check_dedup(first, stream_dedup.dedup_files(spark, str(path), state=state).collect())
    add(older, 30)
    check_dedup(first + older, stream_dedup.dedup_files(spark, str(path), state=state).collect())
    check_dedup(first + older, stream_dedup.dedup_files(spark, str(path)).collect())
    one = next(path.glob("*.parquet"))
    assert len(stream_dedup.dedup_files(spark, str(one)).collect()) in (2, 3)
    one.rename(tmp_path / "gone.parquet")
    with pytest.raises(ValueError, match="changed or removed"):
        stream_dedup.dedup_files(spark, str(path), state=state)


def test_rows_with_maps(spark, sf):
    """Columns that Spark can neither order nor group are carried along."""
    rows = [(1, "Same text", {"a": 1}), (1, "Same text", {"b": 2}), (2, "same TEXT", None), (2, "same text", {}), (None, "x", {"c": 3}), (3, "w " * 9, {"d": 4})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    out = external_shuffle.external_shuffle(docs, 3)
    assert out.columns == ["doc_id", "text", "tags", "shard", "slot"]
    assert sorted(map(str, ((r.doc_id, r.text, r.tags) for r in out.collect()))) == sorted(map(str, rows))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, docs, sf)
        assert left.dtypes == docs.dtypes and 3 <= left.count() <= len(rows)


# --- decontamination


def test_decontaminate_query(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op10_decontaminate(spark, sf).collect()}
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [brute.alnum(t)] for i in range(len(w) - 9)}
    for d, t in docs(spark, sf):
        w = brute.alnum(t)
        maybe = any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9)) or any(len(brute.alnum(x)) < 10 for _, x in items)
        want = brute.contamination(t, items) if maybe else (len(w), 0, 0, brute.sha(""), False)
        assert tuple(got[d])[1:] == want, d


def test_decontaminate_edges(spark):
    rng = random.Random(9)
    text = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(["a", "B", "é", "ß1"], k=n))
    items = [(i, text(rng.choice([1, 3, 11, 14]))) for i in range(12)] + [(50, None), (51, "..."), (None, "zz zz"), (0, "q"), (0, "q")]
    rows = EDGE[:5] + [(100 + i, text(rng.randint(0, 60))) for i in range(60)] + [(900, "ZZ  zz")]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, _hit string")
    for most in (1 << 20, 0):  # broadcast, joined
        found = decontaminate.find_contamination(frame(spark, rows), bench, broadcast_bytes=most)
        got = sorted((str(r.doc_id), r.text or "", r._n_words, sum(s["end"] - s["start"] for s in r._hits), sorted(r._items)) for r in found.collect())
        want = []
        for d, t in rows:
            n, hit, _, _, _ = brute.contamination(t, items)
            met = sorted({str(i) if i is not None else "null" for i, x in items if brute.contamination(t, [(i, x)])[4]})
            want.append((str(d), t or "", n, hit, met))
        assert got == sorted(want)
    clean = decontaminate.remove_documents(found)
    assert clean.columns == frame(spark, []).columns and clean.count() == sum(not w[3] for w in want)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(decontaminate.find_contamination(frame(spark, [(1, "keep zz, ZZ keep"), (2, "n")]), bench.where("item_id is null"))).collect()}
    assert re.sub(r"\W+", " ", cut[1]) == "keep keep" and cut[2] == "n"
    assert decontaminate.find_contamination(frame(spark, []), bench).count() == 0
    assert decontaminate.find_contamination(frame(spark, rows), bench.limit(0)).where("size(_hits) > 0").count() == 0


def test_window_set_is_small():
    """What is broadcast stays below its bound in bytes, also for the shortest words."""
    import pickle

    for word, n in (("a", 200_000), ("word", 100_000)):
        text = " ".join([word] * n)
        assert len(pickle.dumps(decontaminate.WindowSet([("x", text)], 10))) <= decontaminate.PER_BYTE * len(text)


def test_clashing_names(spark, sf):
    """Columns with the names that operators use inside are kept, those with the names of results replaced."""
    inner = ["_key", "_kinds", "_low", "key", "trigram", "_bucket", "_record", "_pos", "_r", "_id", "_text", "_digest", "_d", "_gone_doc_id", "_place", "_own", "k", "_row", "body", "digest"]
    own = ["secrets", "shard", "slot", "_score", "_n_words", "_hits", "_items"]
    rows = [(1, "token=" + "z" * 20, "x", "y", 3), (2, "some words here", "x", "y", 3), (3, "Some words here", "x", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in inner + own:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    kept = lambda df, names: all(r[c] == f"mine {c}" for r in df.collect() for c in names)
    out = secret_scan.scan_secrets(docs)
    assert kept(out, [c for c in inner + own if c != "secrets"]) and sorted(len(r.secrets) for r in out.collect()) == [0, 0, 1]
    out = external_shuffle.external_shuffle(docs, 2)
    assert kept(out, [c for c in inner + own if c not in ("shard", "slot")]) and sorted(r.shard for r in out.collect()) in ([0, 0, 1], [0, 1, 1])
    net = toxicity.Network()
    out = toxicity.score(docs, net)
    assert out.columns.count("_score") == 1 and kept(out, [c for c in inner + own if c != "_score"]) and all(0 <= r._score <= 1 for r in out.collect())
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    for most in (1 << 20, 0):
        out = decontaminate.find_contamination(docs, bench, broadcast_bytes=most)
        assert kept(out, [c for c in inner + own if c not in decontaminate.NAMES]) and sorted(len(r._hits) for r in out.collect()) == [0, 1, 1]
    assert stream_dedup.exact_dedup(docs).where("kept").count() == 2
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and kept(out, inner + own) and out.count() in (2, 3)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 3


def test_sha_of_nothing():
    assert brute.sha("") == hashlib.sha256(b"").hexdigest()
