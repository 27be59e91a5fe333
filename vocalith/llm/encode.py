"""Token ids of whole texts by a public tokenizer file.

The tokenizer of word_bpe_49k.json drops white space and never joins what white space separates, so a text's ids are the
ids of its white-space-separated chunks. Each distinct chunk is encoded once and kept, in sorted numpy arrays, for the
life of the Python worker, up to a bound after which the store starts anew.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import bytescan

STORE = 1_500_000
#: Chunks encoded at a time.
TOGETHER = 8_192


def _chunks() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[0] = 255
    lut[[9, 10, 11, 12, 13, 32]] = 0
    return lut


class ChunkEncoder:
    """ids(column) -> the ids of every text, flat, and where each text begins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.lut = _chunks()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids_flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(texts), TOGETHER):  # an encoding takes far more room than its ids
            found = [e.ids for e in self.batch(texts[i : i + TOGETHER], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flats.append(np.fromiter((i for x in found for i in x), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        at = len(self.ids_flat) + np.cumsum(size) - size
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.ids_flat = np.concatenate([self.ids_flat, flat])

    def _positions(self, column: pa.Array):
        words = bytescan.scan(column, self.lut)
        raw, _ = bytescan.text_buffer(column)
        uniq, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > STORE:
            self._clear()
        at = np.searchsorted(self.keys, uniq)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == uniq) if len(self.keys) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~known)
        if len(new):
            blob, s, e = raw.tobytes(), words.start[first[new]], words.end[first[new]]
            self._learn(uniq[new], [blob[a:b].decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist())])
            at = np.searchsorted(self.keys, uniq)
        return words, at[back] if len(uniq) else np.zeros(0, np.int64)

    def lengths(self, column: pa.Array) -> np.ndarray:
        words, at = self._positions(column)
        total = np.concatenate([[0], np.cumsum(self.size[at])])
        return np.diff(total[words.first])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, at = self._positions(column)
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.at[at] - total[:-1], size) + np.arange(total[-1])
        return self.ids_flat[take], total[words.first]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
