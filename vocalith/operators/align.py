"""Word alignment: A1 edit distance, A2 S/D/I counts, A3 op lists, A4 edit tables, A5 utterance WER.

Word arrays travel to Python in Arrow batches, where words become numbers. One rule makes every alignment: a row of the
edit matrix is two bits per hypothesis word. Short pairs are aligned many at a time, a 64-bit word for each pair's row;
longer pairs one at a time, with rows as long integers, of which only the start of each run is held.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from vocalith.functions.text import words

#: Pairs up to so many reference and hypothesis words (a row has 64 bits) are aligned together, so many at a time.
SHORT_REF, SHORT_HYP, TOGETHER = 256, 64, 1024
#: A long pair is aligned in runs of at least so many rows, more while a run has no more cells than this; of each run the start is held.
_RUN, _RUN_CELLS = 128, 1 << 26
#: Bytes of the rows of bits that are kept for the words of one hypothesis.
_PLACE_BYTES = 1 << 26

_NAMES = {"E": "equal", "S": "sub", "D": "del", "I": "ins"}


def _rows(ref: Sequence, where: _Places, m: int, start: tuple[int, int]):
    """One (diagonal equal, deletion) per reference word, as bits over the m hypothesis words, and the state after it."""
    full = (1 << m) - 1
    up, down = start  # where a row's costs rise and fall from one hypothesis word to the next
    for r in ref:
        same = where.get(r, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        rise = (down | ~(level | up)) & full
        shifted = (rise << 1 | 1) & full
        up, down = (((level & up) << 1) | ~(level | shifted)) & full, shifted & level
        yield level, rise, (up, down)


class _Places:
    """Where each word stands in a hypothesis, as bits. Rows of bits are kept for the frequent words, up to so many bytes; those of others are made from the few places that they have."""

    def __init__(self, hyp: Sequence, most: int = _PLACE_BYTES):
        self.size, self.at = len(hyp) // 8 + 1, {}
        for j, h in enumerate(hyp):
            self.at.setdefault(h, array("l")).append(j)
        often = sorted(self.at, key=lambda h: -len(self.at[h]))[: max(1, most // self.size)]
        self.kept = {h: self._bits(self.at[h]) for h in often}

    def _bits(self, places) -> int:
        row = bytearray(self.size)
        for j in places:
            row[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(row, "little")

    def get(self, word, none: int = 0) -> int:
        held = self.kept.get(word)
        return held if held is not None else self._bits(self.at[word]) if word in self.at else none


def _distance(ref: Sequence, hyp: Sequence) -> int:
    """Levenshtein distance of one pair, a row of bits at a time (Myers, Hyyrö)."""
    if not hyp:
        return len(ref)
    state = ((1 << len(hyp)) - 1, 0)
    for _, _, state in _rows(ref, _Places(hyp), len(hyp), state):
        pass
    return len(ref) + state[0].bit_count() - state[1].bit_count()


def _align(ref: Sequence, hyp: Sequence) -> str:
    """The ops E, S, D, I of one pair in reading order; the last run's rows are at hand, other runs are made again on the way back."""
    n, m = len(ref), len(hyp)
    where, run, state = _Places(hyp), max(_RUN, _RUN_CELLS // max(m, 1)), ((1 << m) - 1, 0)
    held, ways, out = [], [], []
    for i, (level, rise, after) in enumerate(_rows(ref, where, m, state)):
        if i % run == 0:
            held.append(state)
            ways = []
        ways.append((level, rise))
        state = after
    first = (len(held) - 1) * run
    while n or m:
        if not n or not m:
            op = "I" if not n else "D"
        elif ref[n - 1] == hyp[m - 1]:
            op = "E"
        else:
            if n - 1 < first:
                first = (n - 1) // run * run
                ways = [x[:2] for x in _rows(ref[first:n], where, len(hyp), held[first // run])]
            level, rise = ways[n - 1 - first]
            op = "S" if not level >> m - 1 & 1 else "D" if rise >> m - 1 & 1 else "I"
        out.append(op)
        n, m = n - (op != "I"), m - (op != "D")
    return "".join(reversed(out))


def _short_rows(codes: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray):
    """The reference and hypothesis codes of short pairs [word, pair], every row of bits: level and rise [word, pair], and the last state."""
    take = lambda begin, size, pad: np.where((k := np.arange(max(1, int(size.max())))[:, None]) < size, codes[np.minimum(begin + k, max(0, len(codes) - 1))], codes.dtype.type(pad)) if len(codes) else np.full((1, len(size)), pad, codes.dtype)
    r, h = take(at, n, -1), take(other, m, -2)
    one = np.uint64(1)
    of = np.full((len(n), SHORT_HYP), -2, h.dtype)
    of[:, : len(h)] = h.T
    same = np.empty(r.shape, np.uint64)
    for i, x in enumerate(r):
        same[i] = np.packbits(x[:, None] == of, axis=1, bitorder="little").view("<u8")[:, 0]
    up, down = np.full(len(n), ~np.uint64(0)), np.zeros(len(n), np.uint64)
    levels, rises, ends = np.empty_like(same), np.empty_like(same), (up.copy(), down.copy())
    for i in range(same.shape[0]):  # bits beyond a pair's hypothesis never reach those below
        s = same[i]
        level = (((s & up) + up) ^ up) | s | down
        rise = down | ~(level | up)
        shifted = rise << one | one
        up, down = ((level & up) << one) | ~(level | shifted), shifted & level
        levels[i], rises[i] = level, rise
        for end, now in zip(ends, (up, down)):
            np.copyto(end, now, where=i < n)
    return r, h, levels, rises, ends


def _short_ops(codes: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ops of many short pairs, flat, and how many each has."""
    r, h, levels, rises, _ = _short_rows(codes, at, n, other, m)
    pair, i, j, out = np.arange(len(n)), n.copy(), m.copy(), []
    one, (E, S, D, I) = np.uint64(1), (np.uint8(ord(x)) for x in "ESDI")
    while (live := (i > 0) | (j > 0)).any():
        a, b = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        bit = b.astype(np.uint64)
        both = (i > 0) & (j > 0)
        down = (i > 0) & ((j == 0) | (rises[a, pair] >> bit & one == one))
        op = np.where(both & (levels[a, pair] >> bit & one == 0), S, np.where(down, D, I))
        op = np.where(both & (r[a, pair] == h[b, pair]), E, op)
        op[~live] = 0
        out.append(op)
        i -= live & (op != I)
        j -= live & (op != D)
    ops = np.stack(out[::-1], axis=1) if out else np.zeros((len(n), 0), np.uint8)
    return ops[ops > 0], (ops > 0).sum(axis=1)


class _Pairs:
    """A batch of pairs of word lists, null lists as empty ones: words as numbers, where each list begins, how long it is."""

    def __init__(self, ref: pa.ListArray, hyp: pa.ListArray):
        size = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (ref, hyp)]
        both = pa.concat_arrays([x.flatten().cast(pa.string()) for x in (ref, hyp)]).dictionary_encode()
        self.words, self.codes = both.dictionary, np.asarray(both.indices).astype(np.int32)
        self.n, self.m = size
        self.at, self.other = np.cumsum(size[0]) - size[0], size[0].sum() + np.cumsum(size[1]) - size[1]

    def groups(self):
        """Rows of short pairs, of like length, some at a time; then those of long pairs."""
        short = (self.n <= SHORT_REF) & (self.m <= SHORT_HYP)
        rows = np.flatnonzero(short)
        rows = rows[np.argsort(self.n[rows] + self.m[rows], kind="stable")]
        return [rows[i : i + TOGETHER] for i in range(0, len(rows), TOGETHER)], np.flatnonzero(~short).tolist()

    def _lists(self, k: int) -> tuple[list[int], list[int]]:
        return tuple(self.codes[b : b + s].tolist() for b, s in ((self.at[k], self.n[k]), (self.other[k], self.m[k])))

    def ops(self) -> list[bytes]:
        out, (short, long) = [b""] * len(self.n), self.groups()
        for rows in short:
            flat, size = _short_ops(self.codes, self.at[rows], self.n[rows], self.other[rows], self.m[rows])
            blob, end = flat.tobytes(), np.cumsum(size)
            for k, a, b in zip(rows.tolist(), (end - size).tolist(), end.tolist()):
                out[k] = blob[a:b]
        for k in long:
            out[k] = _align(*self._lists(k)).encode()
        return out

    def counts(self) -> list[np.ndarray]:
        """The substitutions, deletions and insertions of each pair."""
        out, (short, long) = [np.zeros(len(self.n), np.int32) for _ in "SDI"], self.groups()
        for rows in short:
            flat, size = _short_ops(self.codes, self.at[rows], self.n[rows], self.other[rows], self.m[rows])
            end = np.cumsum(size)
            for of, x in zip(out, b"SDI"):
                total = np.concatenate([[0], np.cumsum(flat == x)])
                of[rows] = total[end] - total[end - size]
        for k in long:
            ops = _align(*self._lists(k))
            for of, x in zip(out, "SDI"):
                of[k] = ops.count(x)
        return out

    def distances(self) -> np.ndarray:
        out, (short, long) = np.zeros(len(self.n), np.int32), self.groups()
        for rows in short:
            n, m = self.n[rows], self.m[rows]
            *_, (up, down) = _short_rows(self.codes, self.at[rows], n, self.other[rows], m)
            mine = np.where(m < 64, (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
            out[rows] = n + np.bitwise_count(up & mine).astype(np.int64) - np.bitwise_count(down & mine)
        for k in long:
            out[k] = _distance(*self._lists(k))
        return out


@F.arrow_udf(IntegerType())
def _word_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array(_Pairs(ref, hyp).distances(), mask=~np.asarray(pc.and_(ref.is_valid(), hyp.is_valid())))


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in ("substitutions", "deletions", "insertions")]))
def _counts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in _Pairs(ref, hyp).counts()], names=["substitutions", "deletions", "insertions"])


#: Words of both sides whose ops are listed at a time.
LISTED = 1 << 18
_OP = StructType([StructField(c, StringType()) for c in ("op", "ref_word", "hyp_word")])


def _pieces(ref: pa.ListArray, hyp: pa.ListArray, wrong: bool) -> Iterator[pa.ListArray]:
    """The ops of every pair, or those of its errors only; some pairs at a time."""
    size = sum(np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (ref, hyp))
    cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(LISTED, int(size.sum()), LISTED)))
    ends = [0, *(c for c in cuts.tolist() if 0 < c < len(ref)), len(ref)]
    for a, b in zip(ends, ends[1:]):
        yield _listed(ref.slice(a, b - a), hyp.slice(a, b - a), wrong)


def _lists(ref: pa.ListArray, hyp: pa.ListArray, wrong: bool) -> pa.ListArray:
    return pa.concat_arrays(list(_pieces(ref, hyp, wrong)))


def _listed(ref: pa.ListArray, hyp: pa.ListArray, wrong: bool) -> pa.ListArray:
    p = _Pairs(ref, hyp)
    ops = p.ops()
    op = np.frombuffer(b"".join(ops), np.uint8)
    end = np.cumsum(np.concatenate([[0], np.fromiter(map(len, ops), np.int64, len(ops))]))
    # Ops that take a word take the next of their side; all sides lie one after the other.
    sides = [(op != ord("I"), 0), (op != ord("D"), int(p.n.sum()))]
    places = [np.where(on, np.cumsum(on) - 1 + base, 0) for on, base in sides]
    kept = op != ord("E") if wrong else np.ones(len(op), bool)
    end = np.concatenate([[0], np.cumsum(kept)])[end]
    word = [p.words.take(pa.array(p.codes[place[kept]] if len(p.codes) else np.zeros(0, np.int32), mask=~on[kept])) for (on, _), place in zip(sides, places)]
    return pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.StructArray.from_arrays([_named(op[kept]), *word], names=["op", "ref_word", "hyp_word"]))


# Pieces leave a task one by one. Called nondeterministic, as a filter that Spark infers from an explode would list all pairs a second time.
@F.arrow_udf(ArrayType(_OP))
def _op_list(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for ref, hyp in batches:
        yield from _pieces(ref, hyp, False)


@F.arrow_udf(ArrayType(_OP))
def _error_list(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for ref, hyp in batches:
        yield from _pieces(ref, hyp, True)


_op_list, _error_list = _op_list.asNondeterministic(), _error_list.asNondeterministic()


def _named(op: np.ndarray) -> pa.Array:
    place = np.zeros(256, np.int64)
    place[[ord(x) for x in _NAMES]] = np.arange(len(_NAMES))
    return pa.array(list(_NAMES.values())).take(pa.array(place[op]))


def word_edit_distance(ref: Column, hyp: Column) -> Column:
    """A1: Levenshtein distance over words (arrays); null where a side is."""
    return _word_distance(ref, hyp)


def _words(df: DataFrame, side: str) -> Column:
    """The words of a column: white-space tokens of a text, or an array of words as it is; null has none."""
    return F.coalesce(F.col(side), F.array().cast("array<string>")) if isinstance(df.schema[side].dataType, ArrayType) else words(F.col(side))


def align_sdi(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """A2: df with words, substitutions, deletions, insertions, errors. Texts are white-space tokens, or arrays of words; null texts are empty."""
    r = _words(df, ref)
    out = df.withColumn("_sdi", _counts(r, _words(df, hyp)))
    out = out.withColumns({c: F.col(f"_sdi.{c}") for c in ("substitutions", "deletions", "insertions")} | {"words": F.size(r)}).drop("_sdi")
    return out.withColumn("errors", F.col("substitutions") + F.col("deletions") + F.col("insertions"))


def align_ops(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """A3: one row per op with pos, op, ref_word, hyp_word; the missing side is null. Of equal costs the last op is S, else D, else I."""
    listed = df.withColumn("_list", _op_list(_words(df, ref), _words(df, hyp)))
    return listed.select(*df.columns, F.posexplode("_list").alias("pos", "_op")).select(*df.columns, "pos", "_op.op", "_op.ref_word", "_op.hyp_word")


def align_errors(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """A3 for tables of errors: the ops of align_ops other than equal, without pos and the two sides."""
    rest = [c for c in df.columns if c not in (ref, hyp)]
    return df.select(*rest, F.inline(_error_list(_words(df, ref), _words(df, hyp))))


def attach_hypotheses(manifest: DataFrame, hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """Every manifest row with its hypothesis, '' where there is none; `failed` tells the two apart.

    Several hypotheses under one key would multiply rows, so they fail the job instead.
    """
    n = F.count(F.lit(1))
    repeated = F.concat(F.lit("several hypotheses for one key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    one = hypotheses.groupBy(*keys).agg(F.first("hyp").alias("hyp"), n.alias("_n"))
    one = one.select(*keys, F.when(F.col("_n") > 1, F.raise_error(repeated).cast("string")).otherwise(F.col("hyp")).alias("hyp"))
    return manifest.join(one, keys, "left").withColumn("failed", F.col("hyp").isNull()).withColumn("hyp", F.coalesce("hyp", F.lit("")))


def edit_counts(manifest: DataFrame, hypotheses: DataFrame | None, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """A4: the edit table of a manifest and its hypotheses (keys, hyp); None: each row has its own in hyp already, whatever its keys."""
    return align_sdi(manifest if hypotheses is None else attach_hypotheses(manifest, hypotheses, keys), ref, hyp)


def utterance_wer(errors: Column, n: Column) -> Column:
    """A5: errors per word; infinite without words."""
    return F.when(n > 0, errors / n).otherwise(F.lit(float("inf")))
