"""Vectorised scanning of Arrow text columns with numpy.

Texts are handled as the UTF-8 bytes of an Arrow buffer, so no Python string is made per row. A word is a maximal
run of bytes other than 0x20 and 0x09-0x0D; these are ASCII, so byte runs and code point runs agree. Hashes are
64-bit: a polynomial over the bytes modulo 2**64, then a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most `most` bytes of text, or a single row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and where each row starts (one more entry than rows); a null row is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Scan:
    """Runs of bytes found in a slice: `start`, `end` (byte positions), `row` of each and `count` per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self._prefix: np.ndarray | None = None

    def runs(self, kind: np.ndarray) -> Runs:
        """Maximal runs of equal non-zero `kind` (of each byte) that don't cross rows."""
        n = len(kind)
        if not n:
            none = np.zeros(0, np.int64)
            return Runs(self, none, none)
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        edge[self.offsets] = True
        at = np.flatnonzero(edge)
        inside = kind[at[:-1]] != 0
        return Runs(self, at[:-1][inside], at[1:][inside])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes from start to end, the same wherever they stand."""
        n = len(self.data)
        up, down = _power(n + 1)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, _U)
            np.cumsum(_BYTE[self.data] * up[:n], out=self._prefix[1:])
        return mix((self._prefix[end] - self._prefix[start]) * down[start] + (end - start).astype(_U))

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


class Runs:
    def __init__(self, scan: Scan, start: np.ndarray, end: np.ndarray):
        self.start, self.end = start, end
        self.row = np.searchsorted(scan.offsets, start, side="right") - 1
        self.count = np.bincount(self.row, minlength=scan.rows).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # index of each row's first run
        self.hash = scan.hashes(start, end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive runs of a row, and the index of their first run."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        factors = seeds(k, 77)
        total = self.hash[:n] * factors[0]
        for j in range(1, k):
            total += self.hash[j : j + n] * factors[j]
        return mix(total[at]), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Window hashes and their rows, in the order of rows; a row of 1 to k - 1 runs gives one hash of all of them."""
        hashes, at = self.windows(k)
        rows = self.row[at]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            here = np.flatnonzero((self.count < k)[self.row])
            part = self.hash[here] * seeds(k, 77)[here - self.first[self.row[here]]]
            sums = np.add.reduceat(part, np.flatnonzero(np.diff(self.row[here], prepend=-1)))
            hashes = np.concatenate([hashes, mix(sums + self.count[short].astype(_U))])
            rows = np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            hashes, rows = hashes[order], rows[order]
        return hashes, rows


_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_WORD = (~_WHITE).astype(np.uint8)


def scan(column: pa.Array) -> Scan:
    return Scan(*text_bytes(column))


def words(s: Scan) -> Runs:
    """Runs of anything but white space."""
    return s.runs(_WORD[s.data])
