"""N-gram Jaccard self-join with token-combination prefixes.

A document's set holds the 64-bit hashes of its runs of five words. Equal sets are one class from the start, so copies
are never paired. Then:

1. Reach. For overlap a = ceil(0.75 n), two similar sets share k tokens of their first n - a + k, in any common order.
   In hash order and with k a fixed share of n, the tokens of these prefixes are counted in buckets, and classes with
   fewer than k shared tokens cannot have a partner and leave.
2. Classes of tokens. Among the rest, tokens held by more than `FREQUENT` sets are frequent. The common order puts rare
   tokens first, then frequent ones by rising count.
3. Signatures. A rare token of the prefix is a signature by itself. Frequent tokens fall into M sub-classes by hash, and
   each pair inside one sub-class is a signature; the prefix is extended by M, so that two similar sets share a rare
   token or, by the pigeonhole principle, two frequent ones of one sub-class. M follows the size band of the set; a set
   is indexed in its own band and the next, and similar sets share one of them.
4. Verification, in rounds. In lists that hold several components, the member with the least hash leads, the same one in
   most lists, and each member outside its component proposes it; each class verifies the proposal that most of its
   lists share, and what is linked is joined. Lists that still hold several components are then gathered by their
   smallest member, so that most lists of a group of near copies become one cluster. A cluster falls into bands of set
   sizes, so narrow that similar sets are in one band or in two neighbours, and a band into blocks of at most `BLOCK`
   sets and about `BLOCK_TOKENS` tokens. Two blocks of one band or of neighbours meet once, where matrix products count
   the overlap of all their pairs and only the edges of a spanning forest leave. No candidate pair is left unseen.

A class is named by 64 bits of its set's hash; classes that 128 bits tell apart but 64 do not get new names. Lists are
counted by aggregates and joined back, so that a hot signature is no task of its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import FEW_ROWS, release, save, settings, small_or_not
from .components import connected_components

WORDS = 5
#: Similarity is NUM / DEN or more.
NUM, DEN = 75, 100
#: A token held by more sets than this is frequent.
FREQUENT = 16
#: k of step 1, as a share of the set.
REACH = 0.15
#: Sets up to this size also index every token by itself.
SMALL = 16
#: Tokens that a bucket of step 1 and 2 should hold; rounds end when one links less than this share of the proposals.
BUCKET_TOKENS, LEAST_LINKED, MOST_ROUNDS = 500_000, 0.02, 2
#: Bytes of text whose sets are made at a time.
SLICE_BYTES = 1 << 20
#: Bytes of text whose prefixes are dealt to the buckets at a time.
PREFIX_BYTES = 4 << 20
BLOCK, BLOCK_TOKENS, COLUMNS = 512, 250_000, 4096
#: A band of sizes is wider than the least similarity allows two sets to differ.
BAND = math.log(DEN / (NUM - 1))


def token_views(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The packed sets of a binary column without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return [data[a:b].view("<u8") for a, b in zip(at[:-1], at[1:])]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted token sets of a column of texts."""
    w = bytescan.scan(column, bytescan.space_words())
    h, at = bytescan.windows(w, WORDS)
    cut = np.searchsorted(at, w.first)
    out = [np.unique(h[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    count = np.diff(w.first)
    for n in range(1, WORDS):
        rows = np.flatnonzero(count == n)
        if len(rows):
            h, at = bytescan.windows(w, n, salt=n)
            for r, k in zip(rows.tolist(), np.searchsorted(at, w.first[:-1][rows]).tolist()):
                out[r] = h[k : k + 1]
    return out


def class_key(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two numbers that stand for a set: a name of so many bits, and 64 bits more."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    name, more = (int.from_bytes(x, "little", signed=True) for x in (raw[:8], raw[8:]))
    return (name if bits == 64 else name & ((1 << bits) - 1)), more


def least_overlap(n: int) -> int:
    return -(-NUM * n // DEN)


def _reach(n: int) -> int:
    return max(1, math.ceil(REACH * n))


def set_table(docs: DataFrame, key: str, text: str, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, k, k2): the numbers of class_key, null for an empty set."""

    def run(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, text, SLICE_BYTES):
                at = batch.schema.get_field_index
                sets = shingle_sets(batch.column(at(text)))
                names = [class_key(s, bits) if len(s) else (None, None) for s in sets]
                columns = [batch.column(at(key)).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [k for k, _ in names], [k for _, k in names]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "k", "k2"])
            release()

    return docs.select(key, text).mapInArrow(run, "doc_id long, n_shingles long, k long, k2 long")


def renamed(table: DataFrame) -> DataFrame:
    """The table with one k for each pair (k, k2), and `several` where others had the same k."""
    shared = table.where("k is not null").groupBy("k").agg(F.min("k2").alias("_own"), F.max("k2").alias("_other")).where("_own <> _other").select("k", "_own")
    named = table.join(small_or_not(save(shared, "shared-names")), "k", "left").withColumn("several", F.col("_own").isNotNull())
    return named.withColumn("k", F.when(F.col("k2") != F.col("_own"), F.xxhash64("k2", "k")).otherwise(F.col("k"))).drop("_own")


_BLOCK = "bucket int, tokens binary, refs binary, keys binary"


def _blocks(sets: list[np.ndarray], keys: list[int], n_buckets: int):
    """Sets of one block as one row per bucket: tokens, and for each the number of its set among the keys."""
    for i in range(0, len(sets), 60_000):
        part, own = sets[i : i + 60_000], np.array(keys[i : i + 60_000], "<i8")
        size = np.array([len(s) for s in part])
        token = np.concatenate(part) if part else np.zeros(0, np.uint64)
        ref = np.repeat(np.arange(len(part)), size).astype("<u2")
        bucket = ((token & np.uint64(0xFFFFFF)).astype(np.int64) * n_buckets) >> 24
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        rows = [(b, order[x:y]) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x]
        used = [np.unique(ref[o], return_inverse=True) for _, o in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in rows], pa.int32()),
                pa.array([token[o].tobytes() for _, o in rows], pa.binary()),
                pa.array([r.astype("<u2").tobytes() for _, r in used], pa.binary()),
                pa.array([own[u].tobytes() for u, _ in used], pa.binary()),
            ],
            names=["bucket", "tokens", "refs", "keys"],
        )


def _read_blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, key) of one bucket in token order, and the number of keys that hold each token."""
    token, owner = [], []
    for a, b, c in zip(t.column("tokens"), t.column("refs"), t.column("keys")):
        token.append(np.frombuffer(a.as_py(), "<u8"))
        owner.append(np.frombuffer(c.as_py(), "<i8")[np.frombuffer(b.as_py(), "<u2")])
    token, owner = np.concatenate(token), np.concatenate(owner)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    held = np.diff(np.concatenate([first, [len(token)]]))
    return token, owner, np.repeat(held, held)


def _buckets(tokens: int | None) -> int:
    return max(1, math.ceil((tokens or 0) / BUCKET_TOKENS))


def shared_tokens(docs: DataFrame, text: str, n_tokens: int, bits: int = 64) -> DataFrame:
    """(k, shared): how many tokens of a class's reach prefix other classes hold in theirs. n_tokens: about as many there are."""
    n_buckets = _buckets(n_tokens)

    def run(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, text, PREFIX_BYTES):
                seen: dict[int, np.ndarray] = {}
                for s in shingle_sets(batch.column(0)):
                    if len(s):
                        seen.setdefault(class_key(s, bits)[0], s[: len(s) - least_overlap(len(s)) + _reach(len(s))].copy())
                yield from _blocks(list(seen.values()), list(seen), n_buckets)
            release()

    def count(t: pa.Table) -> pa.Table:
        _, owner, held = _read_blocks(t)
        k, n = np.unique(owner[held > 1], return_counts=True)
        return pa.table({"k": pa.array(k.astype(np.int64)), "shared": pa.array(n.astype(np.int64))})

    counted = docs.select(text).mapInArrow(run, _BLOCK).groupBy("bucket").applyInArrow(count, "k long, shared long")
    return counted.groupBy("k").agg(F.sum("shared").alias("shared"))


def load_sets(docs: DataFrame, reps: DataFrame, key: str, text: str) -> DataFrame:
    """(k, n, tokens) of the classes in reps (rep, k, k2), from the texts of their representatives."""

    def run(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, "_text", SLICE_BYTES):
                at = batch.schema.get_field_index
                rows = [(k, s) for k, k2, s in zip(batch.column(at("k")).to_pylist(), batch.column(at("k2")).to_pylist(), shingle_sets(batch.column(at("_text")))) if len(s) and class_key(s)[1] == k2]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], names=["k", "n", "tokens"])
            release()

    joined = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(small_or_not(reps), F.col("_id").eqNullSafe(F.col("rep")))
    return joined.select("_text", "k", "k2").mapInArrow(run, "k long, n long, tokens binary")


def frequent_tokens(sets: DataFrame) -> DataFrame:
    """(k, found): for each class its frequent tokens and their counts, as arrays of packed pieces (no more than the set has)."""
    n_buckets = _buckets(sets.agg(F.sum("n").alias("t")).first().t)

    def run(batches):
        for batch in batches:
            yield from _blocks(token_views(batch.column(1)), batch.column(0).to_pylist(), n_buckets)

    def find(t: pa.Table) -> pa.Table:
        token, owner, held = _read_blocks(t)
        token, owner, held = (x[held > FREQUENT] for x in (token, owner, held))
        order = np.argsort(owner, kind="stable")
        k, first = np.unique(owner[order], return_index=True)
        parts = np.split(order, first[1:]) if len(k) else []
        rows = {
            "k": pa.array(k.astype(np.int64)),
            "token": pa.array([token[p].tobytes() for p in parts], pa.binary()),
            "held": pa.array([held[p].astype("<i8").tobytes() for p in parts], pa.binary()),
        }
        return pa.table(rows)

    found = sets.select("k", "tokens").mapInArrow(run, _BLOCK).groupBy("bucket").applyInArrow(find, "k long, token binary, held binary")
    return found.groupBy("k").agg(F.collect_list(F.struct("token", "held")).alias("found"))


def _bands(n: int) -> tuple[int, int]:
    b = int(math.log(n) / math.log(DEN / NUM))
    return b, b + 1


def _sub_classes(band: int) -> int:
    return max(1, int((DEN / NUM) ** band / 16))


def _wrap(seed: int) -> np.uint64:
    return np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def signatures(tokens: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The signatures of a set; held has the count of each frequent token and 0 for rare ones."""
    n = len(tokens)
    order = np.lexsort((tokens, held))
    token, rare = tokens[order], held[order] == 0
    out = []
    if n <= SMALL:
        out.append(bytescan.mix(tokens ^ _wrap(1)))
    if n >= 12:
        for band in _bands(n):
            m = _sub_classes(band)
            cut = min(n, n - least_overlap(n) + 1 + m)
            out.append(token[:cut][rare[:cut]])
            often = token[:cut][~rare[:cut]]
            sub = bytescan.mix(often ^ _wrap(band + 2)) % np.uint64(m)
            by = np.lexsort((often, sub))
            often, sub = often[by], sub[by]
            lag = 1
            while lag < len(often) and (same := sub[lag:] == sub[:-lag]).any():
                out.append(bytescan.mix(bytescan.mix(often[:-lag][same] ^ _wrap(band + 2)) + often[lag:][same]))
                lag += 1
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def postings(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(sig, k, n), one row for each signature of each class."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            rows = zip(batch.column(at("k")).to_pylist(), batch.column(at("n")).to_pylist(), token_views(batch.column(at("tokens"))), batch.column(at("found")))
            for k, n, tokens, found in rows:
                found = found.as_py()
                held = np.zeros(len(tokens), np.int64)
                for f in found or []:
                    held[np.searchsorted(tokens, np.frombuffer(f["token"], "<u8"))] = np.frombuffer(f["held"], "<i8")
                sig = signatures(tokens, held).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.full(len(sig), k)), pa.array(np.full(len(sig), n))], names=["sig", "k", "n"])

    return sets.join(frequent, "k", "left").select("k", "n", "tokens", "found").mapInArrow(run, "sig long, k long, n long")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def run(batches):
        for batch in batches:
            ok = []
            for i, (s, t) in enumerate(zip(token_views(batch.column(2)), token_views(batch.column(3)))):
                both = len(s) + len(t) - len(np.union1d(s, t))
                if DEN * both >= NUM * (len(s) + len(t) - both):
                    ok.append(i)
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    side = lambda c, v: sets.select(F.col("k").alias(c), F.col("tokens").alias(v))
    return pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def _alike(x: str, y: str):
    return F.least(x, y) * DEN >= F.greatest(x, y) * NUM


def _placed(live: DataFrame, comps: DataFrame | None) -> DataFrame:
    """live (sig, k, n) with comp."""
    if comps is None:
        return live.withColumn("comp", F.col("k"))
    return live.join(small_or_not(comps.select(F.col("node").alias("k"), "root")), "k", "left").select("sig", "k", "n", F.coalesce("root", "k").alias("comp"))


def _mixed(placed: DataFrame, what) -> DataFrame:
    """One row for each list that holds several components, with an aggregate of it."""
    return placed.groupBy("sig").agg(what, F.min("comp").alias("_least"), F.max("comp").alias("_most")).where("_least <> _most").drop("_least", "_most")


def similar_classes(live: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root): components of the similar pairs of classes; live: postings (sig, k, n)."""
    links, comps = None, None
    for turn in range(MOST_ROUNDS):
        placed = _placed(live, comps)
        leads = _mixed(placed, F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("h"), "k", "n", "comp")).alias("lead"))
        met = placed.join(leads, "sig").where("comp <> lead.comp").where(_alike("n", "lead.n"))
        best = met.groupBy("k", F.col("lead.k").alias("lead")).agg(F.count(F.lit(1)).alias("c")).groupBy("k").agg(F.max(F.struct("c", "lead")).alias("m"))
        proposed = save(best.select(F.col("k").alias("a"), F.col("m.lead").alias("b")), "proposed")
        found = save(verify(proposed, sets), "links")
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links)
        if found.count() <= LEAST_LINKED * proposed.count():
            break
    placed = _placed(live, comps)
    clusters = save(placed.join(_mixed(placed, F.min("k").alias("root")), "sig").select("k", "n", "root").distinct(), "list-clusters")
    return connected_components(links.unionByName(save(verify_clusters(clusters, sets), "links-last")))


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the true cells of close connect."""
    edges, rows, columns = [], np.zeros(close.shape[0], bool), np.zeros(close.shape[1], bool)
    for first in np.flatnonzero(close.any(axis=1)).tolist():
        todo = [] if rows[first] else [(True, first)]
        rows[first] = True
        while todo:
            is_row, i = todo.pop()
            seen = columns if is_row else rows
            new = np.flatnonzero((close[i] if is_row else close[:, i]) & ~seen).tolist()
            seen[new] = True
            edges += [(i, x) if is_row else (x, i) for x in new]
            todo += [(not is_row, x) for x in new]
    return edges


def _close(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which sets of a and b are similar: overlaps by matrix products over the tokens that both sides hold."""
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (a, b)]
    both = np.intersect1d(flat[0][0], flat[1][0])
    held = []
    for token, owner in flat:
        at = np.minimum(np.searchsorted(both, token), max(0, len(both) - 1))
        ok = both[at] == token if len(both) else np.zeros(len(token), bool)
        held.append((at[ok], owner[ok]))
    shared = np.zeros((len(a), len(b)), np.float64)
    for c in range(0, len(both), COLUMNS):
        sides = []
        for (at, owner), n in zip(held, (len(a), len(b))):
            m = np.zeros((n, COLUMNS), np.float32)
            inside = (at >= c) & (at < c + COLUMNS)
            m[owner[inside], at[inside] - c] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    total = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])
    return DEN * shared >= NUM * (total - shared)


def verify_clusters(clusters: DataFrame, sets: DataFrame, most_sets: int = BLOCK, most_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Edges (a, b) that connect all similar classes of each cluster (k, n, root)."""
    banded = clusters.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int"))
    size = save(banded.groupBy("root", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / most_sets, F.sum("n") / most_tokens)).cast("int").alias("blocks")), "bands")
    next_to = lambda step, name: size.select("root", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    known = size.join(next_to(1, "up"), ["root", "band"], "left").join(next_to(-1, "down"), ["root", "band"], "left")
    dealt = banded.join(small_or_not(save(known, "bands-known")), ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))

    def meet(n: str, band, up: int, i, j, right):
        """Where a set meets the blocks 0 to n - 1 of its own band (up = 0) or of a neighbour."""
        each = lambda x: F.struct(band.alias("band"), F.lit(up).alias("up"), i(x).alias("i"), j(x).alias("j"), right.alias("right"))
        return F.transform(F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), each)

    own, band, no = F.col("block"), F.col("band"), F.lit(False)
    meets = F.concat(
        meet("blocks", band, 0, lambda x: F.least(own, x), lambda x: F.greatest(own, x), no),
        meet("up", band, 1, lambda x: own, lambda x: x, no),
        meet("down", band - 1, 1, lambda x: x, lambda x: own, F.lit(True)),
    )
    placed = save(dealt.select("k", "root", "block", meets.alias("meets")), "clusters")
    each = sets.select("k", "tokens").join(placed, "k").select("root", "block", "k", "tokens", F.explode("meets").alias("_m"))
    each = each.select("root", "block", "k", "tokens", "_m.band", "_m.up", "_m.i", "_m.j", "_m.right")

    def run(t: pa.Table) -> pa.Table:
        up, i, j = (t.column(c)[0].as_py() for c in ("up", "i", "j"))
        rows = list(zip(t.column("block").to_pylist(), t.column("right").to_pylist(), t.column("k").to_pylist(), token_views(t.column("tokens"))))
        left = [r[2:] for r in rows if (not r[1] if up else r[0] == i)]
        right = [r[2:] for r in rows if (r[1] if up else r[0] == j)]
        edges = _forest(_close([s for _, s in left], [s for _, s in right])) if left and right else []
        release()
        return pa.table({"a": pa.array([left[x][0] for x, _ in edges], pa.int64()), "b": pa.array([right[y][0] for _, y in edges], pa.int64())})

    return each.groupBy("root", "band", "up", "i", "j").applyInArrow(run, "a long, b long").where("a <> b")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of docs.

    Words are lower-cased in A-Z; fewer than five words are one shingle; null and empty texts have no shingle, class or
    link, and are their own component. Documents link at Jaccard 0.75 or more; component_id is the smallest doc_id
    reachable. Repeated rows are alike; a null id is returned with its component, but never names one unless all its
    members are null; an empty table gives an empty table. Extra columns are ignored. Sets are compared by the 64-bit
    hashes of their shingles. bits: how many name a class at first.
    """
    with settings(docs.sparkSession, FEW_ROWS):
        table = renamed(save(set_table(docs, key, text, bits), "sets"))
        classes = table.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("k2").alias("k2"), F.first("several").alias("several"))
        n_tokens = table.agg(F.sum("n_shingles").alias("t")).first().t or 0
        shared = shared_tokens(docs, text, int(n_tokens * (1 - NUM / DEN + REACH)), bits)
        needed = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(REACH)))
        # What classes of one name share was not counted apart, so all of them stay.
        in_reach = F.col("several") | (F.col("shared") >= needed)
        reps = save(classes.join(shared, "k", "left").where(in_reach).select("k", "k2", "rep"), "reps")
        sets = save(load_sets(docs, reps, key, text), "set-tokens")
        held = save(postings(sets, frequent_tokens(sets)), "postings")
        live = save(held.join(held.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sig", "left_semi"), "live")
        roots = similar_classes(live, sets)
    named = roots.join(classes.select(F.col("k").alias("node"), "rep"), "node")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("least")), "root").select(F.col("node").alias("k"), "least")
    # Stored, so that a join beyond the bound meets plain tables and Spark may split the rows of a class with many copies.
    of = save(classes.join(small_or_not(save(named, "named")), "k", "left").select("k", F.coalesce("least", "rep").alias("component")), "class-components")
    return table.join(small_or_not(of), "k", "left").select("doc_id", "n_shingles", F.col("k").alias("class_id"), F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
