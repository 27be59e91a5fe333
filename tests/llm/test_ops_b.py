"""Structure repair, filter audit and line dedup against plain versions."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.llm import filter_audit, line_dedup, queries
from vocalith.llm import structure_repair as S

from . import brute

# --- structure repair


def machine(state, initial):
    """Where a kept or written row of this initial leads, or None."""
    if initial == "s" and state == 0:
        return 1
    if initial == "u" and state in (0, 1, 3):
        return 2
    return 3 if initial == "a" and state == 2 else None


def all_edits(rows, inserts=2):
    """(cost, edits) of every way to edit rows (initial, fault), with at most so many inserts in one place."""

    def go(i, state, cost, edits, free):
        if i == len(rows) and state in (0, 3):
            yield cost, edits
        if free:
            yield from go(i, machine(state, "a" if state == 2 else "u"), cost + 3, edits + "I", free - 1)
        if i < len(rows):
            initial, fault = rows[i]
            yield from go(i + 1, state, cost + 4, edits + "D", inserts)
            if fault not in (S.BLANK, S.DUPLICATE):
                late = 3 * (fault == S.TRUNCATED)
                if (to := machine(state, initial)) is not None:
                    yield from go(i + 1, to, cost + late, edits + "K", inserts)
                yield from go(i + 1, machine(state, "a" if state == 2 else "u"), cost + late + 3, edits + "R", inserts)

    return go(0, 0, 0, "", inserts)


def greedy(rows):
    """The same by another way: costs to the end, then the least edit that keeps the best cost."""
    far = 10**9
    steps = lambda i, q: [(e, j, to, c) for e, j, to, c in _moves(rows, i, q) if to is not None]
    todo = [[far] * 4 for _ in range(len(rows) + 2)]
    for i in range(len(rows), -1, -1):
        todo[i] = [0 if i == len(rows) and q in (0, 3) else far for q in range(4)]
        for _ in range(3):
            for q in range(4):
                todo[i][q] = min([todo[i][q]] + [c + todo[j][to] for _, j, to, c in steps(i, q)])
    out, i, q = [], 0, 0
    while not (i == len(rows) and q in (0, 3) and todo[i][q] == 0):
        e, i, q = next((e, j, to) for e, j, to, c in sorted(steps(i, q)) if c + todo[j][to] == todo[i][q])
        out.append(e)
    return todo[0][0], "".join(out)


def _moves(rows, i, q):
    turn = machine(q, "a" if q == 2 else "u")
    out = [("I", i, turn, 3)]
    if i < len(rows):
        initial, fault = rows[i]
        out.append(("D", i + 1, q, 4))
        if fault not in (S.BLANK, S.DUPLICATE):
            late = 3 * (fault == S.TRUNCATED)
            out += [("K", i + 1, machine(q, initial), late), ("R", i + 1, turn, late + 3)]
    return out


def random_rows(rng, n):
    return [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_repair_is_least_of_all():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5):
        for _ in range(60):
            rows = random_rows(rng, n)
            want = min(all_edits(rows))
            assert S.solve_whole(tuple((c, f, 1) for c, f in rows))[0][2:] == want == greedy(rows), rows


@pytest.mark.parametrize("prime", [S._PRIME, 2, 7])
def test_repair_of_long_conversations(prime, monkeypatch):
    """In blocks or in one piece, with a hash that never collides and with ones that nearly always do."""
    monkeypatch.setattr(S.Edits.__init__, "__defaults__", (prime,))
    rng = random.Random(2)
    S.solve_whole.cache_clear()
    for rows in [random_rows(rng, 400), [("t", 0)] * 301, [("u", 0)] * 300, [("a", 3)] * 200 + [("s", 0)] * 3]:
        runs = tuple((c, f, 1) for c, f in rows)
        want = greedy(rows)
        assert S.solve_whole(runs)[0][2:] == want
        for size in (1, 7, 150):
            assert S.join_blocks([S.solve_block(runs[i : i + size]) for i in range(0, len(runs), size)]) == want
    S.solve_whole.cache_clear()


def test_common_prefix():
    rng = random.Random(3)
    for prime in (S._PRIME, 3):
        e = S.Edits(prime)
        nodes = [0] + [e.add(rng.randint(0, i), "".join(rng.choices("DK", k=rng.randint(1, 3)))) for i in range(300)]
        for _ in range(500):
            a, b = rng.choice(nodes), rng.choice(nodes)
            x, y = e.text(a), e.text(b)
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert e.common(a, b) == n and e.less(a, b) == (x < y)


def damaged(turns):
    out, ids = defaultdict(list), []
    for conv, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        ids.append(conv)
        how = brute.crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return {c: sorted(out[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], brute.sha(r[2]))) for c in ids}


def repaired(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        t = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append(S.BLANK if not t else S.DUPLICATE if (role, text) in seen else S.TRUNCATED if t[-1] not in ".!?" else S.NONE)
        seen.add((role, text))
    cost, audit = greedy([(r[1][:1], f) for r, f in zip(rows, faults)])
    i, state, kept = 0, 0, []
    for e in audit:
        said = "a" if state == 2 else "u"
        if e == "K":
            said = rows[i][1][:1]
            kept.append(f"{rows[i][1]}:{rows[i][2]}")
        elif e != "D":
            kept.append({"u": "user", "a": "assistant"}[said] + ":" + (rows[i][2] if e == "R" else ""))
        state = state if e == "D" else machine(state, said)
        i += e != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in (S.BLANK, S.DUPLICATE, S.TRUNCATED)), illegal, cost, audit, brute.sha("\n".join(kept))


def check_repair(turns, got):
    want = {str(c): repaired(rows) for c, rows in damaged(turns).items()}
    assert {str(r.conv_id): tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repair_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repair(turns, queries.op11_structure_repair(spark, sf).collect())


def test_repair_edges(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "a\nb"]
    texts = ["Yes.", "no", "  ", None, "", "What?\n", "é!", " ", "x" * 50_000 + "."]
    turns = [(rng.randint(1, 12), rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    turns += [(77, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(60)] + [(78, 5, "user", "Same.")] * 40 + [(None, 1, "user", "Q?"), (None, 2, "assistant", "A.")]
    turns += [(79, t, "user", "again.") for t in range(50)] + [(80, -(2**62), "user", "x."), (80, 2**62, "assistant", "y.")]
    turns += [(c, 1, "user", "Only.") for c in range(100, 160)]  # of some of them nothing is left
    df = spark.createDataFrame([(*t, True, "z") for t in turns], "conv_id long, turn long, role string, text string, gone boolean, facts string")
    for size in (1, 3, 1024):
        check_repair(turns, S.repair(S.damage(df), size).collect())
    assert S.repair(S.damage(df.limit(0))).count() == 0


# --- filter audit


def plain_mask(text, smaller):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), smaller]
    return frozenset(i for i, f in enumerate(fails) if f)


def check_audit(rows, labels, got):
    """rows: (doc_id, text, source). Every order is walked document by document."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for d, t, s in rows:
        parts[s or ""].append((plain_mask(t or "", d is not None and d > least[t or ""]), d in good, d in toxic))
    want, share = {}, Counter()
    for part, docs in parts.items():
        for order in itertools.permutations(range(5)):
            left = docs
            for k, f in enumerate(order):
                out = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                share[part, f] += len(out)
                fails = sum(f in x[0] for x in docs)
                want[part, "".join("ABCDE"[i] for i in order), k + 1] = [len(left), len(out), fails - len(out), sum(x[0] == {f} for x in docs), sum(x[1] for x in out), sum(x[2] for x in out)]
    assert len(got) == len(want)
    for r in got:
        f = "ABCDE".index(r.filter_order[r.step - 1])
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step] + [share[r.part, f]]


def test_audit_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    check_audit(rows, labels, queries.op12_filter_audit(spark, sf).collect())


def test_audit_edges(spark):
    rng = random.Random(5)
    bits = ["a", "b", "C", "Word", "ÄÖ", "#", "x|y", "\n", " ", "\x0b", "word word"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.choice([0, 3, 60, 90]))), rng.choice(["s", "t", None, ""])) for i in range(60)]
    rows += [(5, None, "s"), (6, "", "s"), (7, " \t", None), (None, "copy", "t"), (None, "copy", "t"), (70, "copy", "t"), (70, "copy", "t"), (71, "copy", "t"), (72, "Copy", "t"), (73, "w " * 30_000 + "W", "t")]
    rows += [(1000 + i, "hot", "s") for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(80)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, mask int, digest string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    check_audit(rows, labels, filter_audit.audit(filter_audit.masks(df, known)).collect())
    check_audit(rows, [], filter_audit.audit(filter_audit.masks(df, known.limit(0))).collect())
    assert filter_audit.audit(filter_audit.masks(df.limit(0), known)).count() == 0


def test_walk_is_every_subset():
    counts = np.random.default_rng(6).integers(0, 50, (3, 32, 3))
    kept = filter_audit.walk(counts)
    for subset in range(32):
        assert (kept[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


# --- line dedup


def plain_lines(rows, least=40, documents=5):
    key = lambda x: brute.low(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                holders[k].append(d)
    keep = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= documents}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == d]
        out.append((str(d), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def cut(df):
    return sorted((str(r.doc_id), r._n_lines, r._n_dropped, r.text) for r in df.collect())


def test_line_dedup_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op13_line_dedup(spark, sf).collect())
    assert got == sorted((d, n, k, brute.sha(t)) for d, n, k, t in plain_lines(rows))


def line_rows():
    rng = random.Random(7)
    lines = ["a" * 39, "b" * 40, "B" * 40, " \t" + "b" * 40 + "\r", "é" * 39 + " é", "é" * 38, "", "own", "line that is long enough to be a key in this test", "x" * 9000]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(60)]
    rows += [(None, None), (None, ""), (61, "\n\n"), (62, "L" * 40 + "\n" + "l" * 40), (None, "n" * 45), (None, "n" * 45)] + [(None, "m" * 45)] * 6 + [(63, "twice" * 10)] * 5 + [(64, "twice" * 10)]
    return rows + [(65 + i, "y" * 50 + f"\n{i} " + "z" * 50) for i in range(4)] + [(200 + i, "hot line " * 8) for i in range(150)]


@pytest.mark.parametrize("options", [{}, {"table_bytes": 0}, {"filter_bytes": 64}, {"table_bytes": 0, "filter_bytes": 16}])
def test_line_dedup_edges(spark, options):
    rows = line_rows()
    schema = "doc_id long, text string, _id string, _line string, _d string, _lost string, _keep string, _n_lines string"
    df = spark.createDataFrame([(*r, *"123456") for r in rows], schema)
    out = line_dedup.dedup_lines(df.repartition(5), **options)
    assert out.columns == [c for c in df.columns if c != "_n_lines"] + ["_n_lines", "_n_dropped"]
    assert cut(out) == plain_lines(rows)
    assert all((r._id, r._line, r._d, r._lost, r._keep) == tuple("12345") for r in out.collect())
    assert line_dedup.dedup_lines(df.limit(0), **options).count() == 0


def test_filter_never_forgets(spark):
    """Whatever its size and however its parts are dealt, the second filter holds every key that two rows have."""
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = Counter(k for _, t in rows for k in {k for k in line_dedup.line_keys((t or "").encode(), 40) if k is not None})
    for n, most in ((1, 1 << 20), (7, 1 << 20), (7, 16)):
        words = line_dedup.seen_twice(df.repartition(n), filter_bytes=most)
        hit = line_dedup.Bloom(words).has(line_dedup._hashes(keys))
        assert all(h for h, c in zip(hit, keys.values()) if c > 1)
        if most > 16:
            assert sum(h for h, c in zip(hit, keys.values()) if c == 1) <= 1


def test_repeat_table_tells_keys_apart():
    keys = [f"key {i}".encode() * 9 for i in range(50)]
    table = line_dedup.RepeatTable([(line_dedup.digest(k) + line_dedup._hashes([k])[0].tobytes(), i if i % 3 else None) for i, k in enumerate(keys[:30])])
    got = table.drops(keys + [None], [1] * 51)
    assert got.tolist() == [i != 1 for i in range(30)] + [False] * 21


def test_queries_have_plain_types(spark, sf):
    assert [t for _, t in queries.op12_filter_audit(spark, sf).dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert dict(queries.op13_line_dedup(spark, sf).dtypes) == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}
    assert queries.op13_line_dedup(spark, sf).where(F.col("n_dropped") < 0).count() == 0
