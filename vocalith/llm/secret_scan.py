"""Secret scanning with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over lower-cased trigrams when the plan is made. The
documents are indexed by the trigrams that these queries use (one posting per document and trigram); the postings of a
query are intersected per alternative, and only candidates are verified by the rule's expression. A rule whose
expression has no mandatory trigram is verified on every document.
"""

from __future__ import annotations

import itertools
import re._constants as _op
import re._parser as _sre
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, save, small_or_not


@dataclass(frozen=True)
class Rule:
    """kind; the expression (ASCII letters of fold in either case are written with (?i:...)); the group whose length counts, and its least length."""

    kind: str
    pattern: str
    group: int
    least: int


#: The three base kinds, in the order in which equal starts are listed.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Further kinds, by the public formats of these keys.
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]

_MOST = 16  # strings followed exactly before they are given up


def _strings(tree) -> list[set[str] | None]:
    """The expression as a row of parts: the set of strings that a part can be, or None where it can be too much."""
    parts: list[set[str] | None] = []
    for kind, arg in tree:
        if kind is _op.LITERAL:
            parts.append({chr(arg).lower()})
        elif kind is _op.IN and len(arg) <= _MOST and all(k is _op.LITERAL for k, _ in arg):
            parts.append({chr(c).lower() for _, c in arg})
        elif kind is _op.SUBPATTERN:
            parts += _strings(arg[-1])
        elif kind is _op.BRANCH:
            options = [_whole(_strings(x)) for x in arg[1]]
            parts.append(None if None in options else set().union(*options))
        elif kind in (_op.MAX_REPEAT, _op.MIN_REPEAT) and arg[1] <= 2:
            inner = _whole(_strings(arg[2]))
            parts.append(None if inner is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(inner, repeat=n)})
        else:
            parts.append(None)
    return parts


def _whole(parts: list[set[str] | None]) -> set[str] | None:
    out = {""}
    for p in parts:
        if p is None or len(out) * len(p) > _MOST:
            return None
        out = {a + b for a in out for b in p}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which a matching text meets one: sets of lower-cased trigrams that it must all hold. Empty: no mandatory trigram."""
    runs: list[set[str]] = [{""}]
    for p in _strings(_sre.parse(pattern)):
        if p is None:
            runs.append({""})
        elif len(runs[-1]) * len(p) <= _MOST:
            runs[-1] = {a + b for a in runs[-1] for b in p}
        else:
            runs.append(set(p))
    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    best: list[frozenset[str]] = []
    for run in runs:
        query = [grams(s) for s in run]
        if all(query) and min(map(len, query)) > min(map(len, best), default=0):
            best = query
    return sorted(set(best), key=sorted)


def build_index(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index of docs over the given trigrams: one posting (trigram, key) for each document that holds it."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = F.filter(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return docs.select(F.col(key).alias("key"), low.alias("_low")).select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """Intersect the postings: (key, kinds) with the kinds whose query the document meets."""
    spark = index.sparkSession
    clauses = [(r.kind, k, t, len(c)) for r in rules for k, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)]
    dim = spark.createDataFrame(clauses, "kind string, clause int, trigram string, needs int")  # as large as the rules
    met = (
        index.join(F.broadcast(dim), "trigram")
        .groupBy("key")
        .agg(F.collect_set(F.struct("kind", "clause", "needs", "trigram")).alias("hits"))  # at most one entry per rule trigram
        .select("key", F.explode(F.array(*[F.when(_meets(F.col("hits"), r), F.lit(r.kind)) for r in rules])).alias("kind"))
        .where("kind is not null")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _meets(hits: Column, rule: Rule) -> Column:
    def held(clause: int) -> Column:
        return F.size(F.filter(hits, lambda h: (h["kind"] == rule.kind) & (h["clause"] == clause)))

    out = F.lit(False)
    for k, c in enumerate(trigram_query(rule.pattern)):
        out = out | (held(k) == len(c))
    return out


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, end), code points, failing ones dropped."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    length = F.transform(found, F.length) if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), F.zip_with(found, length, lambda m, n: F.struct(F.length(m).alias("m"), n.alias("n"))), lambda g, x: F.struct(F.length(g).alias("g"), x.m.alias("m"), x.n.alias("n")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    walked = F.filter(_walk(steps, rank), lambda s: s["n"] >= rule.least)
    spans = F.transform(walked, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.when(F.rlike(text, F.lit(rule.pattern)), spans).otherwise(none)


def _walk(steps: Column, rank: int) -> Column:
    """Where the matches of (gap, match length, group length) begin and end: each where the gaps and matches before it end.

    A list that grows in an aggregate is copied at every step, so the matches are walked in runs of about the square root
    of their number: first the lengths of the runs, then each run from where it begins.
    """
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps))).cast("int"))

    def of_runs(packed: Column) -> Column:
        n = packed["size"]
        cuts = F.sequence(F.lit(0), F.floor((F.size(packed["steps"]) - 1) / n).cast("int"))
        runs = F.transform(cuts, lambda i: F.slice(packed["steps"], i * n + 1, n))
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        total = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["g"] + x["m"])
        starts = F.aggregate(runs, begun, lambda acc, run: F.struct((acc["at"] + total(run)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

        def walk(run: Column, start: Column) -> Column:
            at = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,n:int>>").alias("out"))

            def step(acc, x):
                begin = acc["at"] + x["g"]
                span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["m"]).alias("end"), x["n"].alias("n"))
                return F.struct((begin + x["m"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

            return F.aggregate(run, at, step, lambda acc: acc["out"])

        return F.flatten(F.zip_with(runs, starts, walk))

    # One element, so that the runs and their size are made once.
    return F.flatten(F.transform(F.array(F.struct(steps.alias("steps"), size.alias("size"))), of_runs))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """All columns of docs and `secrets`, array<struct<start, rank, end>> sorted by start, then the order of the rules.

    A null or empty text has no secrets; a null key is matched like any value; rows that share a key are verified one by
    one, each on its own text; an empty table gives an empty table. Extra columns stay; a column `secrets` is replaced.
    """
    rules = rules or BASE_RULES + MORE_RULES
    indexed = [r for r in rules if trigram_query(r.pattern)]
    grams = sorted({t for r in indexed for c in trigram_query(r.pattern) for t in c})
    found = candidates(build_index(docs, key, text, grams), indexed)
    docs = docs.drop("secrets")
    k, kinds = free(docs, "_key"), free(docs, "_kinds")
    found = small_or_not(save(found.select(F.col("key").alias(k), F.col("kinds").alias(kinds)), "secret-candidates"))
    joined = docs.join(found, docs[key].eqNullSafe(F.col(k)), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(body, rule, rank)
        if rule in indexed:
            spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))
        each.append(spans)
    return joined.withColumn("secrets", F.sort_array(F.concat(*each))).drop(k, kinds)


def span_text(spans: Column, rules: list[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
