"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from xxhash import xxh3_64_intdigest

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longer words are hashed one by one.
LONG = 256
_table = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64; kept in the worker."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base & ((1 << 64) - 1), U64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=U64)
    return _powers[base][:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=out[1:], dtype=U64)
    return out


def span_hashes(sums: np.ndarray, inverse: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of values[start:stop] from prefix_sums(values, base): equal for equal contents at any place."""
    return (sums[stop] - sums[start]) * powers(inverse, len(sums))[start]


@dataclass
class Words:
    """hashes: of all words in order; offsets: the words of text k are offsets[k]:offsets[k + 1]."""

    hashes: np.ndarray
    offsets: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Split texts at ASCII white space (0x20, 0x09-0x0D) and hash the words."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
    start, stop = edge[0::2], edge[1::2]
    sums = prefix_sums(_table[raw], _BASE)
    hashes = mix(span_hashes(sums, _INVERSE, start, stop) + (stop - start).astype(U64))
    for k in np.flatnonzero(stop - start > LONG):
        hashes[k] = xxh3_64_intdigest(joined[start[k] : stop[k]])
    heads = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return Words(hashes, np.searchsorted(start, heads))
