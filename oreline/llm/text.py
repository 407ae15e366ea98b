"""Vectorised text primitives shared by the Arrow-batch operators.

Everything here works on the UTF-8 bytes of a batch of documents at once: word
boundaries, word hashes and word tables come out as numpy arrays over the whole
batch, so no per-word Python code runs.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _table(word: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(word)] = True
    return out


#: Bytes of words matched by [^\x20\x09-\x0D]+.
SPACED = _table(b for b in range(256) if b != 0x20 and not 9 <= b <= 13)
#: Bytes of words matched by [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lower-cased.
ALNUM = _table(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and what one task needed shouldn't stay with the next."""
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Splits batches so that the text of each holds `limit` bytes at most, or one row."""
    try:
        yield from _slices(batches, column, limit)
    finally:
        release()


def _slices(batches: Iterable[pa.RecordBatch], column: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
        _, offsets = utf8(col)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a batch: `counts` per document, byte ranges, and the bytes as compared."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        self.offsets = offsets
        self.low = LOWER[data] if lower else data
        n = len(data)
        is_word = kind[self.low]
        before = np.zeros(n + 1, bool)
        before[1:] = is_word
        before[offsets] = False
        self.start = np.flatnonzero(is_word & ~before[:-1])
        after = np.zeros(n + 1, bool)
        after[:-1] = is_word
        after[offsets] = False
        self.end = np.flatnonzero(is_word & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.is_word = is_word

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def array(self) -> pa.Array:
        """The words as an Arrow binary array, without a Python object for each."""
        packed = self.low[self.is_word]
        ends = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])

    def hashes(self) -> np.ndarray:
        return ranges_hash(self.low, self.start, self.end)


_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in ((0, _BASE), (1, _INVERSE)):
        if len(_powers[k]) < n:
            size = max(n, 1 << 16)
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def ranges_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte ranges, by prefix sums modulo 2**64."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for every i with n values left, order kept."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * U64(0x2545F4914F6CDD1D) + h[k : len(h) - n + 1 + k]
    return mix(out)


def within(counts: np.ndarray, n: int) -> np.ndarray:
    """Which starts of n-grams over the concatenated words stay in their document."""
    total = int(counts.sum())
    keep = np.ones(max(total - n + 1, 0), bool)
    ends = np.cumsum(counts)
    for k in range(1, n):
        at = ends - k
        at = at[(at >= 0) & (at < len(keep)) & (at >= ends - counts)]
        keep[at] = False
    return keep
