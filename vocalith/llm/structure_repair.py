"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles, with their audit.

Kept roles must spell `(s?(ua)+)?`, so a dynamic program over four states (nothing kept, system kept, user last, assistant
last) walks the rows. The edits so far are a linked node: prefixes are shared, every node knows its ancestors at powers of
two and the rolling hash of all its edits. Of equally cheap edits the ASCII-least win; two of them are compared at the end
of their longest common prefix, which a search over hashes finds and a comparison of the edits themselves verifies.

A conversation may be longer than a task. Rows (narrow ones: a text is its faults and its SHA-256) are sorted by ranges
over all tasks and cut into blocks. A block is solved from every state that may stand before it, and the blocks of a
conversation are joined by the same program, whose nodes then hold the edits of whole blocks. Texts are read again in
order, one at a time, to hash what is left of a conversation.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, save

#: The costs of edits.
RECAST, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: States: nothing kept, a system row, a user row, an assistant row last. Where u and a lead.
STATES = 4
_AFTER_USER, _AFTER_ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
#: Faults of a row.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Runs of rows in a block.
BLOCK = 1024

_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6


class Edits:
    """Strings of edits as linked nodes. Node 0 is empty; a node adds a piece, of one edit or of many, to its parent."""

    def __init__(self, prime: int = _PRIME):
        self.prime = prime
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... nodes above
        self.piece = [""]
        self.depth = [0]
        self.length = [0]
        self.hash = [0]

    def _hashed(self, h: int, piece: str) -> int:
        for c in piece:
            h = (h * _BASE + ord(c)) % self.prime
        return h

    def add(self, parent: int, piece: str) -> int:
        up = [parent]
        for k in range(len(self.up)):
            if k >= len(self.up[up[k]]):
                break
            up.append(self.up[up[k]][k])
        self.up.append(up)
        self.piece.append(piece)
        self.depth.append(self.depth[parent] + 1)
        self.length.append(self.length[parent] + len(piece))
        self.hash.append(self._hashed(self.hash[parent], piece))
        return len(self.up) - 1

    def _covering(self, node: int, n: int) -> int:
        """The ancestor of node (or node) whose piece holds edit n, counted from 1."""
        for k in range(len(self.up[node]) - 1, -1, -1):
            if k < len(self.up[node]) and self.length[self.up[node][k]] >= n:
                node = self.up[node][k]
        return node

    def prefix_hash(self, node: int, n: int) -> int:
        if n == 0:
            return 0
        at = self._covering(node, n)
        above = self.up[at][0]
        return self.hash[at] if n == self.length[at] else self._hashed(self.hash[above], self.piece[at][: n - self.length[above]])

    def edit(self, node: int, n: int) -> str:
        """Edit n, counted from 0."""
        at = self._covering(node, n + 1)
        return self.piece[at][n - self.length[self.up[at][0]]]

    def text(self, node: int, above: int = 0) -> str:
        """All edits of node after those of its ancestor above."""
        out = []
        while node != above:
            out.append(self.piece[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _fork(self, a: int, b: int) -> int:
        """The last common ancestor, by ancestors at powers of two."""
        if self.depth[a] < self.depth[b]:
            a, b = b, a
        more, k = self.depth[a] - self.depth[b], 0
        while more:
            if more & 1:
                a = self.up[a][k]
            more, k = more >> 1, k + 1
        if a == b:
            return a
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return self.up[a][0]

    def common(self, a: int, b: int) -> int:
        """The length of the longest common prefix: searched by hashes from the fork on, then verified edit by edit."""
        fork = self._fork(a, b)
        begin = lo = self.length[fork]
        hi = min(self.length[a], self.length[b])
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.prefix_hash(a, mid) == self.prefix_hash(b, mid):
                lo = mid
            else:
                hi = mid - 1
        if lo > begin:
            x, y = self.text(a, fork)[: lo - begin], self.text(b, fork)[: lo - begin]
            if x != y:  # hashes collided
                return begin + next(i for i, (p, q) in enumerate(zip(x, y)) if p != q)
        return lo

    def less(self, a: int, b: int) -> bool:
        """Are the edits of a before those of b in ASCII order?"""
        if a == b:
            return False
        n = self.common(a, b)
        if n == min(self.length[a], self.length[b]):
            return self.length[a] < self.length[b]
        return self.edit(a, n) < self.edit(b, n)


#: The cheapest edits that lead to each state: state -> (cost, node).
Frontier = dict[int, tuple[int, int]]


def _offer(edits: Edits, to: Frontier, state: int, cost: int, parent: int, piece: str) -> bool:
    held = to.get(state)
    if held is not None and held[0] < cost:
        return False
    node = edits.add(parent, piece)
    if held is None or cost < held[0] or edits.less(node, held[1]):
        to[state] = (cost, node)
        return True
    return False


def with_inserts(edits: Edits, at: Frontier) -> Frontier:
    """at, and what inserts lead to. Two in a row come back to the same state, so few rounds are needed."""
    changed = True
    while changed:
        changed = False
        for state, (cost, node) in list(at.items()):
            to = _AFTER_ASSISTANT.get(state) or _AFTER_USER[state]
            if to not in at or cost + INSERT <= at[to][0]:
                changed |= _offer(edits, at, to, cost + INSERT, node, "I")
    return at


def after_row(edits: Edits, at: Frontier, initial: str, fault: int) -> Frontier:
    """One row further: delete, keep or recast it, then insert."""
    out: Frontier = {}
    for state, (cost, node) in at.items():
        _offer(edits, out, state, cost + DELETE, node, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        paid = cost + (UNFINISHED if fault == TRUNCATED else 0)
        to = _AFTER_USER if initial == "u" else _AFTER_ASSISTANT if initial == "a" else {0: 1} if initial == "s" else {}
        if state in to:
            _offer(edits, out, to[state], paid, node, "K")
        _offer(edits, out, _AFTER_ASSISTANT.get(state) or _AFTER_USER[state], paid + RECAST, node, "R")
    return with_inserts(edits, out)


def after_run(edits: Edits, at: Frontier, initial: str, fault: int, n: int) -> Frontier:
    """n equal rows further: all but the first are duplicates, or blank like it."""
    at = after_row(edits, at, initial, fault)
    if n > 1:
        at = with_inserts(edits, {s: (cost + DELETE * (n - 1), edits.add(node, "D" * (n - 1))) for s, (cost, node) in at.items()})
    return at


def start(edits: Edits) -> Frontier:
    return with_inserts(edits, {0: (0, 0)})


def best(edits: Edits, at: Frontier) -> tuple[int, str]:
    """The cheapest legal end: nothing kept, or an assistant last."""
    ends = [at[s] for s in (0, 3) if s in at]
    cost, node = ends[0]
    for c, n in ends[1:]:
        if c < cost or c == cost and edits.less(n, node):
            cost, node = c, n
    return cost, edits.text(node)


#: The state "before" of a table that begins at the legal start.
BEGIN = -1
Entry = tuple[int, int, int, str]  # state before, state after, cost, edits


@functools.lru_cache(maxsize=1 << 15)
def solve_whole(runs: tuple[tuple[str, int, int], ...]) -> list[Entry]:
    """The table of a conversation that is whole: its one best line. Short conversations repeat, so answers are kept."""
    edits = Edits()
    at = start(edits)
    for run in runs:
        at = after_run(edits, at, *run)
    return [(BEGIN, 3, *best(edits, at))]


def solve_block(runs: tuple[tuple[str, int, int], ...]) -> list[Entry]:
    """The cheapest and least edits of a block of runs (initial, fault, n) between every two states."""
    out = []
    for before in range(STATES):
        edits = Edits()
        at: Frontier = {before: (0, 0)}
        for run in runs:
            at = after_run(edits, at, *run)
        out += [(before, after, cost, edits.text(node)) for after, (cost, node) in sorted(at.items())]
    return out


def join_blocks(tables: list[list[Entry]]) -> tuple[int, str]:
    """The cost and the edits of a conversation from the tables of its blocks, in order."""
    if tables and tables[0] and tables[0][0][0] == BEGIN:
        return tables[0][0][2:]
    edits = Edits()
    at = start(edits)
    for table in tables:
        out: Frontier = {}
        for before, after, cost, text in table:
            if before in at:
                _offer(edits, out, after, at[before][0] + cost, at[before][1], text)
        at = out
    return best(edits, at)


# --- the tables


def damage(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) as the contract damages them, `gone` where a row is dropped; nulls are one space.

    The CRC-32 of `conv_id:turn` modulo 20 says how: 0 drops the row, 1 empties its text, 2 takes its sentence marks, 3
    repeats it, 4 makes it the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), how.alias("_how"))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_how") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_how") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


#: Fixed value: the characters that leave a text blank.
SPACES = " \t\n\x0b\x0c\r"


def row_facts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, sha, fault, n, gone): runs of equal rows with their first fault, duplicates of earlier rows included.

    A row that is gone only names its conversation. Equal rows meet in partial counts, so a hot text is few rows.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    solid = F.rtrim("text", F.lit(SPACES))
    fault = F.when(F.length(solid) == 0, BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    rows = turns.withColumn("_gone", gone)
    here = lambda c, other: F.when(F.col("_gone"), other).otherwise(c)
    rows = rows.select(
        "conv_id", here(F.col("turn"), F.lit(None)).alias("turn"), here(F.col("role"), F.lit("")).alias("role"),
        here(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("sha"), here(fault, F.lit(NONE)).cast("int").alias("fault"), F.col("_gone").alias("gone"),
    )
    runs = save(rows.groupBy("conv_id", "turn", "role", "sha", "fault", "gone").agg(F.count(F.lit(1)).alias("n")), "repair-runs")
    # A text said again by the same role: the first of its runs stays, by an aggregate and a join, not by a window over a hot text.
    told = runs.where("not gone").groupBy("conv_id", "role", "sha").agg(F.count(F.lit(1)).alias("_runs"), F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))).alias("_first"))
    told = told.where("_runs > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("sha") == F.col("_s")) & ~F.col("gone")
    again = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.b"))
    fault = F.when(again & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    return runs.join(told, same, "left").select("conv_id", "turn", "role", "sha", fault.cast("int").alias("fault"), "n", "gone")


_ENTRY = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCKS = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("sha", pa.binary()), ("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in _COUNTS], ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("entries", pa.list_(_ENTRY))]
)
_BLOCKS_DDL = "conv_id long, turn long, role string, sha binary, first string, last string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", low long, high long, turns long, entries array<struct<before:int,after:int,cost:long,edits:string>>"
_FACTS = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string())])
_FACTS_DDL = "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string"


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _block(runs: list[dict], whole: bool) -> dict:
    """What a conversation needs to know of a block of its runs: where it stands, counts, and the table of its edits."""
    held = [r for r in runs if not r["gone"]]
    counts, before = dict.fromkeys(_COUNTS, 0), None
    for r in held:
        initial, n = r["role"][:1], r["n"]
        counts["blank" if r["fault"] == BLANK else "duplicate"] += n - 1
        if r["fault"] != NONE:
            counts[_COUNTS[r["fault"] - 1]] += 1
        counts["illegal"] += (before is not None and not legal(before, initial)) + (n - 1) * (not legal(initial, initial))
        before = initial
    turns = {r["turn"] for r in held if r["turn"] is not None}
    plain = tuple((r["role"][:1], r["fault"], r["n"]) for r in held)
    return {
        **{c: runs[0][c] for c in ("conv_id", "turn", "role", "sha")}, "first": held[0]["role"][:1] if held else None, "last": before, **counts,
        "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(turns),
        "entries": [dict(zip(("before", "after", "cost", "edits"), e)) for e in (solve_whole if whole else solve_block)(plain)],
    }


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows, schema: pa.Schema, most: int = 500):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def blocks(facts: DataFrame, size: int = BLOCK) -> DataFrame:
    """The blocks of all conversations. Rows are dealt by ranges of their order, so one conversation may lie in many tasks."""
    order = ["conv_id", "turn", "role", "sha"]

    def cut(rows):
        held, key, first, begun = [], None, True, False
        for row in rows:
            if begun and row["conv_id"] != key:
                # The first conversation of a task may have begun in the one before.
                yield _block(held, whole=not first)
                held, first = [], False
            elif len(held) >= size:
                yield _block(held, whole=False)
                held, first = [], True
            begun, key = True, row["conv_id"]
            held.append(row)
        if held:
            yield _block(held, whole=False)  # and the last one may go on

    def run(batches):
        yield from _batches(cut(_rows(batches)), _BLOCKS)

    ranged = facts.repartitionByRange(partitions(facts.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, _BLOCKS_DDL)


def _facts(parts: list[dict]) -> dict:
    """A conversation from its blocks, in order."""
    out = {"conv_id": parts[0]["conv_id"], **{c: sum(p[c] for p in parts) for c in _COUNTS}}
    turns, last, high = 0, None, None
    for p in parts:
        if p["first"] is not None:
            out["illegal"] += last is not None and not legal(last, p["first"])
            last = p["last"]
        if p["turns"]:
            turns += p["turns"] - (p["low"] == high)
            high = p["high"]
    low = min((p["low"] for p in parts if p["turns"]), default=None)
    out["gaps"] = 0 if low is None else high - low + 1 - turns
    out["cost"], out["audit"] = join_blocks([[tuple(e[c] for c in ("before", "after", "cost", "edits")) for e in p["entries"]] for p in parts])
    return out


def audits(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of turns(conv_id, turn, role, text[, gone])."""

    def join(rows):
        held: list[dict] = []
        for row in rows:
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield _facts(held)
                held = []
            held.append(row)
        if held:
            yield _facts(held)

    def run(batches):
        yield from _batches(join(_rows(batches)), _FACTS)

    # A row per block meets here: about as many bytes as the audits have that are returned.
    parts = blocks(row_facts(turns), size)
    ordered = parts.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "sha")
    return ordered.mapInArrow(run, _FACTS_DDL)


class _Repaired:
    """The SHA-256 of a repaired conversation whose rows come one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.any, self.sha = audit, 0, 0, False, hashlib.sha256()

    def _emit(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":").encode())
        self.sha.update(text.encode())
        self.any = True

    def _target(self) -> str:
        self.state = _AFTER_ASSISTANT.get(self.state) or _AFTER_USER[self.state]
        return "user" if self.state == 2 else "assistant"

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._emit(self._target(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            self._emit(role, text)
        elif edit == "R":
            self._emit(self._target(), text)

    def end(self) -> str:
        self._inserts()
        if self.at != len(self.audit):
            raise ValueError("the audit and the rows of a conversation do not fit")
        return self.sha.hexdigest()


def repair(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Audits with `repaired_sha256`, the hash of what is left of every conversation of turns(conv_id, turn, role, text[, gone]).

    Rows stand by turn (null first), then role, then the SHA-256 of their text; equal rows are duplicates of the first. A
    null role or text is one space. A row that is `gone` counts for nothing but that its conversation exists; without
    rows a conversation has zeros, no audit and the hash of nothing. A null conv_id is a conversation; a role with
    another initial than s, u or a can be recast or deleted. An empty table gives an empty one. Extra columns are ignored.

    The hash needs a conversation's texts in order: one task streams them, and holds one text and the audit at a time.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    extra = [F.coalesce("gone", F.lit(False)).alias("gone")] if "gone" in turns.columns else [F.lit(False).alias("gone")]
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"), *extra)
    found = save(audits(turns, size), "repair-audits")
    facts = F.struct(*[c for c in found.columns if c != "conv_id"])
    heads = found.select("conv_id", F.lit(0).alias("o"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("sha"), F.lit("").alias("text"), facts.alias("facts"))
    body = turns.where("not gone").select("conv_id", F.lit(1).alias("o"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text", F.lit(None).cast(heads.schema["facts"].dataType).alias("facts"))
    schema = _FACTS.append(pa.field("repaired_sha256", pa.string()))

    def apply(rows):
        head, now = None, None
        for row in rows:
            if row["o"] == 0:
                if head is not None:
                    yield head | {"repaired_sha256": now.end()}
                head = {"conv_id": row["conv_id"], **row["facts"]}
                now = _Repaired(head["audit"])
            else:
                now.row(row["role"], row["text"])
        if head is not None:
            yield head | {"repaired_sha256": now.end()}

    def run(batches):
        yield from _batches(apply(_rows(batches)), schema)

    ordered = heads.unionByName(body).repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "o", "turn", "role", "sha")
    return ordered.mapInArrow(run, _FACTS_DDL + ", repaired_sha256 string")
