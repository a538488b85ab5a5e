"""Numpy kernels over Arrow text columns: word spans, word hashes and word shingles.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. All kernels
work on the UTF-8 buffer of many documents at once; nothing loops over words.
Hashes are functions of the bytes alone, so they agree between tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20  # text bytes handled at once; a longer document is handled alone
SHINGLE = 5

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_STEP = U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (Steele, Lea, Flood 2014): spreads every input bit over the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def give_back() -> None:
    """Return memory that is free to the system: the worker may be idle, or serve other tasks next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text is about ``limit`` bytes at most."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (positions in ``raw``), and each document's first word's index."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = space
    before[offsets[offsets < n]] = True  # a document's start
    after = np.empty(n, bool)
    after[:-1] = space[1:]
    after[-1] = True
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    starts = np.flatnonzero(before[:n] & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial over its bytes and its length, mixed."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U(1)) * _power(_MULTIPLIER, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every document, and the offsets of documents in that array."""
    raw, offsets = utf8(column)
    starts, ends, first = spans(raw, offsets)
    return span_hashes(raw, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside a document, and the documents' offsets.

    A document of 1 to k-1 words has one shingle of all its words; one without words has none.
    """
    counts = np.diff(first)
    own = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(int(offsets[-1]), np.uint64)
    doc = np.repeat(np.arange(len(counts)), own)
    at = first[doc] + (np.arange(len(out)) - offsets[doc])  # the shingle's first word
    size = np.minimum(counts, k)[doc]
    factor = U(1)
    for j in range(k):
        here = size > j
        if here.all():
            out += words[at + j] * factor
        else:
            out[here] += words[at[here] + j] * factor
        factor = U((int(factor) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    return mix(out + size.astype(np.uint64)), offsets


def runs(codes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside a document, and the documents' offsets: differences of one polynomial's sums."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(_MULTIPLIER, len(codes)), out=total[1:])
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], n)
    return mix((total[at + k] - total[at]) * _power(_INVERSE, len(codes) + 1)[at]), offsets


def by_document(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of documents 0..n-1 in a sorted array of document numbers."""
    return np.searchsorted(doc, np.arange(n + 1))
