"""Vectorised hashing of words and shingles over flat UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
#: What a byte adds to the hash of its word.
VALUE = np.where(SPACE, U(0), LOWER.astype(np.uint64) + U(1))
#: Bytes of text that are handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def powers(base: int) -> np.ndarray:
    """base**0 .. base**(SLICE_BYTES-1) modulo 2**64."""
    table = np.full(SLICE_BYTES, base, dtype=np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about SLICE_BYTES bytes."""
    data, offsets = flat(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word with A-Z lower-cased, number of words before each text and in all)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE.take(data)
    start = ~space
    start[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] |= ~space[edges]
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # bytes count by their place in the data; the odd BASE has an inverse, which takes the place of the first byte out again
    value, back = VALUE.take(data), pow(BASE, -1, 1 << 64)
    for k in range(0, len(data), SLICE_BYTES):
        part = value[k : k + SLICE_BYTES]
        part *= powers(BASE)[: len(part)]
        if k:
            part *= U(pow(BASE, k, 1 << 64))
    hashed = np.add.reduceat(value, first)
    if len(data) <= SLICE_BYTES:
        hashed *= powers(back).take(first)
    else:
        hashed *= powers(back).take(first % SLICE_BYTES)
        hashed *= np.array([pow(back, k, 1 << 64) for k in range(0, len(data), SLICE_BYTES)], dtype=np.uint64).take(first // SLICE_BYTES)
    return mix(hashed + ODD), np.searchsorted(first, offsets, side="left")


def shingles(hashed: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words, offsets per text); a shorter text is one run, no words none."""
    count = np.diff(before)
    per_text = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    out = np.empty(offsets[-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(hashed) >= size:
            runs = len(hashed) - size + 1
            total = np.zeros(runs, dtype=np.uint64)
            for k in range(size):
                total = total * U(0xD1342543DE82EF95) + hashed[k : k + runs]
            total = mix(total + U(size))
            text = np.repeat(np.arange(len(count)), count)
            inside = text[:runs] == text[size - 1 :]
            place = np.repeat(count >= size, per_text)
            out[place] = total[inside]
        for row in np.flatnonzero((count > 0) & (count < size)):
            total = U(0)
            for h in hashed[before[row] : before[row + 1]]:
                total = total * U(0xD1342543DE82EF95) + h
            out[offsets[row]] = mix(np.array([total + U(count[row])], dtype=np.uint64))[0]
    return out, offsets
