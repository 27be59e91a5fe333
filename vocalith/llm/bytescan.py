"""Vectorised word scanning over the bytes of an Arrow string column.

Words are found and hashed on the column's own buffer with numpy, a megabyte at a time, so that memory stays bounded
and no Python string is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15


def _ascii_lower_table() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def space_words() -> np.ndarray:
    """Byte table for words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. 0 separates, so byte 0 itself becomes 255."""
    lut = _ascii_lower_table()
    lut[0] = 255
    lut[[9, 10, 11, 12, 13, 32]] = 0
    return lut


def alnum_words() -> np.ndarray:
    """Byte table for words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; 0 separates."""
    lut = _ascii_lower_table()
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = True
    keep[128:] = True
    lut[~keep] = 0
    return lut


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        for slot, b in enumerate((_BASE | 1, pow(_BASE | 1, -1, 1 << 64))):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            _POWERS.insert(slot, np.cumprod(p, dtype=np.uint64))
        del _POWERS[2:]
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """All words of a column: byte ranges in data (already lower-cased), the row of each, and where each row's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len rows + 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def scan(column: pa.Array, lut: np.ndarray) -> Words:
    """The words of every text of the column, with 64-bit hashes."""
    data, offsets = text_buffer(column)
    low = lut[data]
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends, hashes = [], [], []
    a = 0
    while a < n:
        b = min(n, a + CHUNK)
        while b < n:  # cut where no word is cut
            gap = np.flatnonzero((low[a:b] == 0) | edge[a + 1 : b + 1])
            if len(gap):
                b = a + int(gap[-1]) + 1
                break
            b = min(n, b + CHUNK)
        part = low[a:b]
        inside = part != 0
        s = inside.copy()
        s[1:] &= ~inside[:-1] | edge[a + 1 : b]
        e = inside.copy()
        e[:-1] &= ~inside[1:] | edge[a + 1 : b]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        if len(s):
            power, inverse = _powers(len(part))
            v = _VALUES[part] * power[: len(part)]
            v[~inside] = 0
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(mix(np.add.reduceat(v, s) * inverse[s]))
        a = b
    cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    start = cat(starts, np.int64)
    return Words(low, start, cat(ends, np.int64), cat(hashes, np.uint64), np.searchsorted(start, offsets))


def windows(words: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words inside one row, and the first word of each."""
    h, n = words.hash, len(words.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n - size + 1, np.uint64(salt * 2 + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE | 1) + h[k : n - size + 1 + k]
    ok = np.ones(n - size + 1, bool)
    last = words.first[1:] - 1  # a run may not begin in the last size-1 words of a row
    for k in range(size - 1):
        bad = last - k
        bad = bad[(bad >= words.first[:-1]) & (bad < len(ok))]
        ok[bad] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cut a batch into runs of rows of about most bytes of text, at least one row each."""
    data = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pc.fill_null(pc.binary_length(data), 0)).astype(np.int64)
    total = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
