"""Vectorised word hashing over Arrow string columns.

The helpers here turn a whole Arrow batch of texts into flat NumPy arrays
(one 64-bit hash per word plus per-document offsets) without creating a
Python object per word.  Words are maximal runs of bytes other than
``\\x20`` and ``\\x09-\\x0D``; these bytes never occur inside a multi-byte UTF-8
sequence, so byte-wise splitting equals code-point-wise splitting.

A null text counts as an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E6D62D06F6A9A9B)
_powers = np.ones(1, dtype=np.uint64)
#: Bytes hashed at a time; bounds the temporaries, not the text.
_SLICE_BYTES = 1 << 20


def _power_table(n: int) -> np.ndarray:
    """Powers of the base modulo 2**64, grown on demand for very long words."""
    global _powers
    if len(_powers) < n:
        size = max(n, 64, 2 * len(_powers))
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, dtype=np.uint64))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers derived from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@dataclass
class Words:
    """Words of a batch: hashes, byte spans and the offsets of each document."""

    data: np.ndarray  # uint8, all texts one after another
    text_off: np.ndarray  # int64, n + 1 byte offsets
    start: np.ndarray  # int64, byte start of each word
    end: np.ndarray  # int64, byte end of each word
    hash: np.ndarray  # uint64
    off: np.ndarray  # int64, n + 1 word offsets

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.off)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each nonempty byte span; spans must not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    size = end - start
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(total, total[a] + _SLICE_BYTES, "right")) - 1)
        k, where = size[a:b], total[a:b] - total[a]
        inner = np.arange(total[b] - total[a]) - np.repeat(where, k)
        power = _power_table(int(k.max()))
        value = (data[inner + np.repeat(start[a:b], k)].astype(np.uint64) + np.uint64(1)) * power[inner]
        out[a:b] = np.add.reduceat(value, where) + k.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        a = b
    return mix(out)


def hash_words(texts: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """Splits and hashes all texts of an Arrow array."""
    data, text_off = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[text_off] = True
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1] | edge[1:n]
        last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    off = np.searchsorted(start, text_off).astype(np.int64)
    out = hash_spans(data, start, end) if hashes else np.zeros(0, np.uint64)
    return Words(data, text_off, start, end, out, off)


def windows(words: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows in order, and window offsets per document."""
    h = words.hash
    n = len(h)
    room = np.maximum(words.count - k + 1, 0)
    off = np.concatenate([[0], np.cumsum(room)]).astype(np.int64)
    if off[-1] == 0:
        return np.zeros(0, np.uint64), off
    c = constants(k, seed)
    m = n - k + 1
    total = h[:m] * c[0]
    for j in range(1, k):
        total += h[j : j + m] * c[j]
    at = np.arange(off[-1]) - np.repeat(off[:-1], room) + np.repeat(words.off[:-1], room)
    return mix(total[at]), off


def blocks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a batch with about ``limit`` bytes of text each (one text at least)."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, off = text_buffer(col)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield batch.slice(a, b - a)
        a = b
