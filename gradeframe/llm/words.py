"""Words and chunks of Arrow text columns, found on the UTF-8 bytes of a whole batch.

A word is ``[^\\x20\\x09-\\x0D]+``: all separators are ASCII, so bytes decide.
Words are dictionary-encoded per slice, so that costly work (hashing, encoding)
is done once per distinct word and gathered by code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a longer document stands alone.
SLICE_BYTES = 16 << 20
#: What a worker remembers of chunks: bytes in all, and the longest chunk and value.
REMEMBERED_BYTES, LONGEST_CHUNK = 64 << 20, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """``codes[bounds[i]:bounds[i + 1]]`` are document i's words, as places in ``vocab``."""

    codes: np.ndarray
    vocab: pa.Array
    bounds: np.ndarray


class Remembered:
    """Values of chunks that came up before, within a bound of bytes; long chunks are worked out anew each time."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        self.limit, self.size, self.known = limit, 0, {}

    def all_of(self, chunks: list[bytes], work: Callable[[bytes], object]) -> list:
        """``work`` of each of ``chunks``."""
        out = []
        for chunk in chunks:
            value = self.known.get(chunk)
            if value is None:
                value = work(chunk)
                if len(chunk) <= LONGEST_CHUNK:
                    # Two Python objects and a place in the table beside the bytes.
                    self.size += len(chunk) + (len(value) if isinstance(value, bytes) else 0) + 170
                    if self.size > self.limit:
                        self.known, self.size = {}, 0
                    self.known[chunk] = value
            out.append(value)
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of consecutive byte strings."""
    array = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    found = array.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """The words of each text; ``lower`` maps A-Z to a-z first."""
    data, at = text_bytes(column)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    solid = (data != 32) & ((data < 9) | (data > 13))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = at[:-1][at[:-1] < len(data)]
    start[firsts] = solid[firsts]
    begins = np.flatnonzero(start)
    before = np.cumsum(solid, dtype=np.int32)
    codes, vocab = encoded(data[solid], np.append(before[begins] - 1, before[-1:] if len(before) else 0))
    return Words(codes, vocab, np.searchsorted(begins, at))


def hashes(vocab: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in vocab.to_pylist()), np.uint64, len(vocab))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` word hashes, also across documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _MIX
        out += h[j : n + j]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def whole_runs(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``k`` words of one document begin, and the row of each."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][rows]
    return places, rows
