import corpus_pipeline
from vocalith.llm import toxicity
from vocalith.llm.common import table

from . import brute
from .test_ops_a import check_packing, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf, monkeypatch):
    """Each stage on what the one before it kept, against its plain version; the whole run gives the same end."""
    fitted = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    stage = dict(corpus_pipeline.STAGES)
    rows = pairs(docs)

    one = stage["toxicity"](spark, docs, sf).cache()
    assert one.columns == docs.columns == COLUMNS
    import pyarrow as pa

    keep = toxicity.text_scores(fitted[0], pa.array([t for _, t in rows])) < 0.5
    rows = [r for r, k in zip(rows, keep) if k]
    assert pairs(one) == rows

    two = stage["exact dedup"](spark, one, sf).cache()
    last = {}
    for d, t in rows:
        last[brute.low(t)] = max(d, last.get(brute.low(t), d))
    rows = [r for r in rows if last[brute.low(r[1])] == r[0]]
    assert two.columns == COLUMNS and pairs(two) == rows

    three = stage["n-gram Jaccard join"](spark, two, sf).cache()
    least = {d: c for d, _, c in brute.components(rows)}
    rows = [r for r in rows if least[r[0]] == r[0]]
    assert three.columns == COLUMNS and pairs(three) == rows

    four = stage["benchmark decontamination"](spark, three, sf).cache()
    grams = {tuple(w[i : i + 10]) for r in table(spark, sf, "benchmark").collect() for w in [brute.alnum(r.text)] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(g) for g in grams}

    def clean(t):
        w = brute.alnum(t)
        return not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    rows = [r for r in rows if clean(r[1])]
    assert four.columns == COLUMNS and pairs(four) == rows
    check_packing(rows, stage["best-fit packing"](spark, four, sf).collect())
    check_packing(rows, corpus_pipeline.run(spark, sf).collect())


def test_empty(spark, sf):
    docs = frame(spark, []).drop("shard_")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_repeated_rows(spark, sf):
    rows = [(1, "Same text"), (1, "Same text"), (2, "same TEXT"), (2, "same text"), (3, "other"), (None, "x"), (None, "x"), (None, None)]
    docs = frame(spark, rows).drop("shard_")
    out = corpus_pipeline.drop_copies(spark, docs, sf)
    assert out.columns == COLUMNS
    assert sorted(map(str, pairs(out.where("doc_id is not null")))) == ["(2, 'same TEXT')", "(3, 'other')"] and out.where("doc_id is null").count() == 2


def test_rows_without_own_id(spark, sf):
    """Texts that share an id, or have none, are not lost with a copy of another, and of near copies one row stays."""
    copies = lambda rows: sorted(map(str, pairs(corpus_pipeline.drop_copies(spark, frame(spark, rows).drop("shard_"), sf).fillna(-1, "doc_id"))))
    assert copies([(None, "same"), (5, "Same"), (None, "unique")]) == ["(-1, 'unique')", "(5, 'Same')"]
    assert copies([(5, "a"), (7, "A"), (7, "b"), (9, "B")]) == ["(7, 'A')", "(9, 'B')"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text + " x"), (1, text + " y"), (1, "other words stand here alone"), (None, text + " z"), (None, "and these stand here too")]
    near = corpus_pipeline.drop_near_copies(spark, frame(spark, rows).drop("shard_"), sf)
    assert near.columns == COLUMNS
    assert sorted(r.text for r in near.collect()) == sorted([text + " x", "other words stand here alone", "and these stand here too"])
