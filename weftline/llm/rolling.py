"""Hashes of many substrings at once, in numpy, over the bytes of a batch of texts.

A prefix sum of ``value[byte] * BASE**position`` modulo 2**64 gives the hash of any substring by one
subtraction and one multiplication with a power of the inverse of BASE.  ``value`` holds fixed random
64-bit numbers, so equal hashes of different strings are as unlikely as for any 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = np.random.Generator(np.random.PCG64(2024)).integers(1, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: bytes of words made of digits, letters and anything beyond ASCII
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES_LOWER = VALUES[LOWER]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below ``size``; kept by the worker."""
    if len(_powers[0]) < size:
        size = 1 << (size - 1).bit_length()
        for k, base in enumerate((BASE, _INVERSE)):
            up = np.full(size, base, np.uint64)
            up[0] = 1
            _powers[k] = np.multiply.accumulate(up)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Prefix sums, one longer than ``data``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array, offsets from 0; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of words before it (one longer).

    ``inside`` tells which bytes belong to words; by default all but ASCII white space.
    """
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    held = np.zeros(len(data) + 1, bool)
    held[:-1] = ~_SPACE[data] if inside is None else inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # a text's first byte never continues a word
    before = np.zeros(len(data) + 1, bool)
    before[1:] = held[:-1]
    starts = np.flatnonzero(held & (~before | cut))
    ends = np.flatnonzero(before & (~held | cut))
    return starts, ends, np.searchsorted(starts, offsets)
