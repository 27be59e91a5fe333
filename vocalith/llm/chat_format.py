"""Chat formatting by columnar byte assembly.

A turn is written as `### role: content </turn>` and a line end. A backslash goes before every backslash, # and < of a
text (and before : and line ends of a role), so that no text can hold a mark, and taking it off again gives the text
back. For each Arrow batch, segment lengths give cumulative offsets, these give scatter indices, and all headers and
contents are copied into one preallocated buffer that becomes the output column. The loss mask is a byte range in each
segment. A conversation is its segments in order; none is ever held whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import partitions

#: The template.
OPEN, MIDDLE, CLOSE, ESCAPE = b"### ", b": ", b" </turn>\n", 0x5C
_TEXT_ESCAPES, _ROLE_ESCAPES = b"\\#<", b"\\#<:\n"


def _escaped(column: pa.Array, escapes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes with a backslash before each of the escapes, and the new offsets."""
    data, offsets = bytescan.text_buffer(column)
    table = np.zeros(256, np.int64)
    table[list(escapes)] = 1
    before = np.cumsum(table[data])
    out = np.full(len(data) + (int(before[-1]) if len(before) else 0), ESCAPE, np.uint8)
    out[np.arange(len(data)) + before] = data
    return out, offsets + np.concatenate([[0], before])[offsets]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy row i of (data, offsets) to out[at[i]:]."""
    out[np.repeat(at - offsets[:-1], np.diff(offsets)) + np.arange(len(data))] = data


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The segments of a batch of turns, and where in each its content begins and ends (bytes)."""
    (r, r_at), (t, t_at) = _escaped(role, _ROLE_ESCAPES), _escaped(text, _TEXT_ESCAPES)
    n = len(r_at) - 1
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, MIDDLE, CLOSE)]
    begin = len(OPEN) + np.diff(r_at) + len(MIDDLE)
    end = begin + np.diff(t_at)
    offsets = np.concatenate([[0], np.cumsum(end + len(CLOSE))])
    out = np.empty(int(offsets[-1]), np.uint8)
    at = offsets[:-1]
    for where, mark in ((at, fixed[0]), (at + begin - len(MIDDLE), fixed[1]), (at + end, fixed[2])):
        out[(where[:, None] + np.arange(len(mark))).ravel()] = np.tile(mark, n)
    _scatter(out, at + len(OPEN), r, r_at)
    _scatter(out, at + begin, t, t_at)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)), begin, end


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, segment, loss_from, loss_to), one row per turn: a conversation is its segments by turn.

    loss_from and loss_to bound, in bytes of the segment, the content of an assistant's turn and are equal elsewhere.
    Null texts and roles are empty. Turns that share a number stand by role, then segment; repeated rows are turns of
    their own; an empty table gives an empty table; a null conv_id is a conversation. Extra columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for batch in bytescan.slices(whole, "text"):
                at = batch.schema.get_field_index
                role = batch.column(at("role"))
                segments, begin, end = assemble(role, batch.column(at("text")))
                end = np.where(np.array([x == "assistant" for x in role.to_pylist()], bool), end, begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(at("conv_id")), batch.column(at("turn")), role, segments.cast(pa.string()), pa.array(begin), pa.array(end)],
                    names=["conv_id", "turn", "role", "segment", "loss_from", "loss_to"],
                )

    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "conv_id long, turn long, role string, segment string, loss_from long, loss_to long")


def _unescape(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while (j := raw.find(b"\\", i)) >= 0:
        out += raw[i:j] + raw[j + 1 : j + 2]
        i = j + 2
    return bytes(out + raw[i:])


def read_segment(segment: bytes) -> tuple[bytes, bytes]:
    """The role and the text of a segment, from its marks alone."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a segment")
    i = len(OPEN)
    while segment[i : i + len(MIDDLE)] != MIDDLE:
        i += 2 if segment[i] == ESCAPE else 1
        if i >= len(segment):
            raise ValueError("no role mark")
    return _unescape(segment[len(OPEN) : i]), _unescape(segment[i + len(MIDDLE) : -len(CLOSE)])


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, parsed from the segments.

    The segments of a conversation meet in order and pass by one at a time, so its length does not matter for memory.
    """

    def run(batches):
        key, n, turns, loss, loss_chars, chars = None, 0, None, None, 0, 0
        rows: list[tuple] = []
        for batch in batches:
            at = batch.schema.get_field_index
            for conv, segment, a, b in zip(*(batch.column(at(x)).to_pylist() for x in ("conv_id", "segment", "loss_from", "loss_to"))):
                if not n or conv != key:
                    if n:
                        rows.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    key, n, turns, loss, loss_chars, chars = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                raw = segment.encode()
                role, text = read_segment(raw)
                turns.update(role + b"\n" + text + b"\n")
                masked = _unescape(raw[a:b])
                loss.update(masked)
                loss_chars += len(masked.decode())
                chars += len(segment)
                n += 1
            if len(rows) >= 1000:
                yield table(rows)
                rows = []
        if n:
            rows.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield table(rows)

    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])
    ordered = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
