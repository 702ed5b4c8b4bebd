"""Vectorised tokenising and hashing of Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D. All functions work on
whole texts; long batches are cut into sub-batches of whole documents so that
the working arrays stay small whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = 0xD6E8FEB86659FD93
SUB_BATCH_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(_MIX)
    x = x ^ (x >> U(29))
    x = x * U(_BASE)
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(21, int(n).bit_length()))


@dataclass
class Words:
    """The words of some documents: byte spans in ``data``, and ``first[d] .. first[d + 1]`` of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.empty(0, U)
        power, inverse = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * power[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie in one document, and their first words' indexes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(_MIX)
        out += hashes[j : n + j]
    ok = np.ones(n, bool)
    for e in range(1, k):
        bad = first[1:-1] - e
        ok[bad[(bad >= 0) & (bad < n)]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def window(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of windows as windows() gives them, from the hashes of their first words, second words and so on."""
    out = parts[0].copy()
    for x in parts[1:]:
        out *= U(_MIX)
        out += x
    return mix(out)


def words_of(column: pa.Array, lower: bool) -> Words:
    """The words of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and buf.size else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    size = len(data)
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    inside = ~space
    begin, end = inside.copy(), inside.copy()
    if size:
        begin[1:] &= space[:-1] | edge[1:-1]
        end[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets).astype(np.int64))


def sub_batches(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole documents of about SUB_BATCH_BYTES."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.binary_length(batch.column(text).fill_null("")).to_numpy(zero_copy_only=False), np.int64)
        total, begin = 0, 0
        for i, x in enumerate(lengths.tolist()):
            if total and total + x > SUB_BATCH_BYTES:
                yield batch.slice(begin, i - begin)
                total, begin = 0, i
            total += x
        yield batch.slice(begin)


import pyarrow.compute  # noqa: E402,F401  registers pa.compute
