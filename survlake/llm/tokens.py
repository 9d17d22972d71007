"""Words of many texts at once as 64-bit hashes, with numpy over the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash
is a polynomial over its bytes, taken from prefix sums and mixed; equal words have equal
hashes, and two of n different words share one with probability about n²/2⁶⁵.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_tables.get("p", ())) < n:
        n = max(n, 1 << 16)
        for key, b in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            t = np.full(n, b, np.uint64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables["p"], _tables["q"]


def text_blocks(column: pa.Array, max_bytes: int = 1 << 20, max_rows: int = 50_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``max_bytes``; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + max_bytes, "right")) - 1)
        end = min(end, row + max_rows)
        yield row, end, data[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text, last two bytes of each word as a number)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint16)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    inner = offsets[:-1][offsets[:-1] < n]
    head = ~space
    head[1:] &= space[:-1]
    tail = ~space
    tail[:-1] &= space[1:]
    head[inner] = ~space[inner]
    last = offsets[1:][offsets[1:] > 0] - 1
    tail[last] = ~space[last]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    counts = np.diff(np.searchsorted(start, offsets))
    tail = np.where(end - start > 1, low[end - 2], 0).astype(np.uint16) << np.uint16(8) | low[end - 1]
    return mix(h), counts, tail
