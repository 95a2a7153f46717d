"""Words of many texts at once as numpy arrays, straight from Arrow's UTF-8 buffers.

A word is a run of bytes between ASCII white space. Its hash is a polynomial over its bytes; no
Python string is made per text or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = 1 << 12


def _powers(seed: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x, base = 1, (0x9E3779B97F4A7C15 + 2 * seed) | 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_POWER = _powers(1, _PLACES)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BYTE[_SPACE] = 0


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of texts ``first``..: text i of the chunk holds words at[i]..at[i+1]-1."""

    first: int
    data: np.ndarray  # bytes of the chunk
    lower: np.ndarray  # the same, Latin letters in lower case
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    hash: np.ndarray  # of the lower-case bytes

    @property
    def texts(self) -> int:
        return len(self.at) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.at))


def lower_case(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; the length stays."""
    out = _LOWER[data]
    lead = data[:-1] == 0xC3
    if lead.any():
        second = data[1:]
        up = lead & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:][up] += 32
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array, most: int = 1 << 20) -> Iterator[Words]:
    """Chunks of whole texts with about ``most`` bytes; a longer text is a chunk alone."""
    raw, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield _chunk(i, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def _chunk(first: int, data: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(data)
    lower = lower_case(data)
    full = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begins, stops = full.copy(), full.copy()
    begins[1:] &= ~full[:-1] | cut[1:n]
    stops[:-1] &= ~full[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if len(starts):
        place = np.arange(starts[0], n) - np.repeat(starts, np.diff(np.append(starts, n)))
        value = _BYTE[lower[starts[0] :]] * _POWER[place & (_PLACES - 1)]
        hashed = mix(np.add.reduceat(value, starts - starts[0]))
    else:
        hashed = np.zeros(0, np.uint64)
    return Words(first, data, lower, starts, ends, np.searchsorted(starts, bounds), hashed)


def grams(chunk: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' word n-grams, and where each text's begin (as ``at``).

    A text with fewer than n words, but some, has one gram of all of them.
    """
    h, at = chunk.hash, chunk.at
    size = np.diff(at)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(out[-1]) - np.repeat(out[:-1], count) + np.repeat(at[:-1], count)
    stop = np.repeat(at[1:], count)
    got = np.zeros(len(first), np.uint64)
    for k in range(n):
        inside = first + k < stop
        part = h[np.minimum(first + k, max(0, len(h) - 1))] if len(h) else got
        got = np.where(inside, mix(got ^ part, k), got)
    return got, out
