"""Vectorised words and rolling hashes over Arrow text columns.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r (``[^\\x20\\x09-\\x0D]+``); on
UTF-8 those bytes never occur inside a character, so bytes and code points give the same words.
Everything here works on one Arrow batch inside a task and holds a few arrays of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Odd multipliers of the two rolling hashes and the constants of the 64-bit finaliser (fixed values).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (bijective for a fixed seed)."""
    x = x + np.uint64((MIX[0] * (seed + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[2])
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the table is kept for the next batch."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 2**64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        got = _POWERS[base] = (tables[0], tables[1])
    return got


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        _, offsets = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets into them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, o - o[0]


class Words:
    """The words of a text column, flat: ``start``/``end`` in ``buf``; those of row i are ``first[i]:first[i + 1]``."""

    def __init__(self, column: pa.Array, separator: np.ndarray = SPACE):
        self.buf, self.offsets = raw(column)
        n = len(self.buf)
        text = ~separator[self.buf]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.concatenate(([False], text[:-1])) if n else text
        after = np.concatenate((text[1:], [False])) if n else text
        self.start = np.flatnonzero(text & (~before | cut[:-1]))
        self.end = np.flatnonzero(text & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, buf: np.ndarray | None = None) -> np.ndarray:
        """One 64-bit hash for each word, equal for equal bytes."""
        buf = self.buf if buf is None else buf
        up, down = _powers(BYTE_BASE, len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k consecutive words of one row, and the indexes of their first words."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = _powers(WORD_BASE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:n], out=total[1:])
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return mix((total[at + k] - total[at]) * down[at]), at


def extended(schema, **added: str):
    """A copy of a DataFrame's schema with more columns, given as name=type."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*schema.fields, *(StructField(k, _parse_datatype_string(v)) for k, v in added.items())])
