"""Vectorised word work on Arrow string columns.

A block of documents is one byte array plus offsets; words are the maximal runs
of bytes outside ``\\x20 \\x09-\\x0D``. Everything here is numpy over a block, so
a task's memory is bounded by ``BLOCK_BYTES`` (or one document, if longer) and
no Python object is made per word. Hashes are 64 bit.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
LONG_WORD = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _K = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
# odd multipliers for the words of a window, from the golden-ratio sequence
_C = np.array([((k + 1) * 0x9E3779B97F4A7C15 * 0xD6E8FEB86659FD93 | 1) & (2**64 - 1) for k in range(64)], np.uint64)


_TRIM = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None) if ctypes.util.find_library("c") else None


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Consecutive rows of a batch: ``data`` is padded by 8 bytes; word ``i`` is data[starts[i]:ends[i]] of row doc[i]."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)

    def word(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "surrogatepass")


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte data and row offsets of a string column; a null is an empty text."""
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def blocks(col: pa.Array, lower: bool = False, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    data, off = string_parts(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(n, max(j, i + 1))
        yield make_block(data, off, i, j, lower)
        i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, and its executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def make_block(data: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool) -> Block:
    raw = data[off[i]:off[j]]
    body = np.zeros(len(raw) + 8, np.uint8)
    body[:len(raw)] = _LOWER[raw] if lower else raw
    o = off[i:j + 1] - off[i]
    starts, ends = spans(~_SPACE[body[:len(raw)]], o)
    doc = np.searchsorted(o, starts, "right") - 1
    return Block(i, j - i, body, o, starts, ends, doc)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross a row border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[offsets < n]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte slice; ``data`` is padded by 8 bytes. Very long slices go through BLAKE2b."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    lanes = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = mix((lanes[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _K)
    at, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        v = lanes[starts[at] + k] & _MASK[np.minimum(size[at] - k, 8)]
        h[at] = mix(h[at] * _K + v)
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(b: Block) -> np.ndarray:
    return slice_hashes(b.data, b.starts, b.ends)


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``k`` consecutive words of one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return at, window_hashes(h, at, k)


def window_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        s += h[at + j] * _C[j % 64]
    return mix(s)


def keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a row of the block."""
    return mix(h ^ (doc.astype(np.uint64) * _K))


def marked(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags (one per byte) are set in each row."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets, "left"))


def columns(schema: pa.Schema, **arrays) -> pa.RecordBatch:
    made = [arrays[f.name].cast(f.type) if isinstance(arrays[f.name], pa.Array) else pa.array(arrays[f.name], type=f.type)
            for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)
