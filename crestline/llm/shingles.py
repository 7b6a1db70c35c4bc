"""Word shingle sets of whole texts, computed a batch at a time on the bytes.

A word is a run of bytes other than blank and \\x09-\\x0D, with A-Z lowered. Its hash is that of the bytes' polynomial
modulo 2^64; a shingle's hash combines those of five words; a shorter text has one shingle of all its words; a text
without words has none. Sets are sorted arrays of 64-bit hashes, so two shingles are taken as equal with a chance of
about n^2 / 2^65 among n different ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, from 0."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the place of each text's first word (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] ^ ((end - start).astype(np.uint64) << np.uint64(56)))
    return h, np.searchsorted(start, offsets)


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, at = words(*buffers(texts))
    if len(h) >= WIDTH:
        s = h[: len(h) - WIDTH + 1].copy()
        for k in range(1, WIDTH):
            s *= np.uint64(0xD6E8FEB86659FD93)
            s += h[k : len(h) - WIDTH + 1 + k]
        s = mix(s)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WIDTH:
            own = np.sort(s[a : b - WIDTH + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h[k : k + 1])
            yield x
        else:
            yield np.empty(0, np.uint64)
