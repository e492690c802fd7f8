"""Whole-batch text arithmetic inside Arrow tasks: words, lines and n-grams as numpy arrays.

A batch of texts is one byte buffer with offsets. Word hashes are differences of a running
polynomial sum over the buffer, so no Python code runs per word. Chunks hold about
``CHUNK_BYTES`` of text (or one longer text), which bounds the memory of a task.

Words are ``[^\\x20\\x09-\\x0D]+``; a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * _GOLD)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES, 0 if have is None else 2 * len(have))
        have = np.full(size, _BASE if kind == "up" else _UNBASE, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[kind] = have
    return have[:n]


class Texts:
    """Texts of some rows: ``raw`` bytes, ``at`` offsets (one more than rows)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at, self.n = raw, at, len(at) - 1
        self._word = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and offsets of the rows into them."""
        if self._word is None:
            gap = np.ones(len(self.raw) + 1, dtype=bool)
            gap[:-1] = _SPACE[self.raw]
            before = np.empty(len(self.raw) + 1, dtype=bool)
            before[0] = True
            before[1:] = gap[:-1]
            after = gap.copy()
            edge = self.at[:-1][self.at[:-1] < len(self.raw)]
            before[edge] = True
            starts = np.flatnonzero(before[:-1] & ~gap[:-1])
            stop = np.zeros(len(self.raw) + 1, dtype=bool)
            stop[edge] = True
            ends = np.flatnonzero(~gap[:-1] & (after[1:] | stop[1:])) + 1
            self._word = starts, ends, np.searchsorted(starts, self.at)
        return self._word

    def running(self, lower: bool) -> np.ndarray:
        """Running polynomial sum over the bytes."""
        values = (_BYTE_LOWER if lower else _BYTE)[self.raw] * _power("up", len(self.raw))
        out = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum(values, out=out[1:])
        return out

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
        total = self.running(lower)
        h = (total[ends] - total[starts]) * _power("down", len(self.raw) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _GOLD)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        starts, ends, _ = self.words()
        return self.span_hashes(starts, ends, lower)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each \\n-split line, and offsets of the rows into them."""
        breaks = np.flatnonzero(self.raw == 10)
        starts = np.concatenate([self.at[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.at[1:]])
        row_of_break = np.searchsorted(self.at, breaks, side="right") - 1
        row = np.concatenate([np.arange(self.n), row_of_break])
        order = np.lexsort((starts, row))
        # the k-th start of a row belongs to its k-th end: breaks first, the row's end last
        end_row = np.concatenate([row_of_break, np.arange(self.n)])
        end_order = np.lexsort((ends, end_row))
        return starts[order], ends[end_order], np.searchsorted(row[order], np.arange(self.n + 1))


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` items that stays within its row, and the index of its first item."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    first = np.flatnonzero(np.arange(len(hashes)) + n <= row_end)
    if n <= 8:
        h = np.zeros(len(first), dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(_BASE) + hashes[first + j]
        return mix(h), first
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power("up", len(hashes)), out=total[1:])
    return mix((total[first + n] - total[first]) * _power("down", len(hashes) + 1)[first]), first


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(array: pa.Array) -> Texts:
    """Nulls become empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(raw, at - at[0])


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text each, at least one row."""
    array = column(batch, text)
    if len(array) == 0:
        return
    lengths = np.diff(texts_of(array).at)
    piece = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(array)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))
