"""Word and shingle hashes of whole texts, in numpy.

A word is a maximal run of bytes other than ASCII white space. Its 64-bit hash is a polynomial over random byte
values modulo 2**64, mixed; words over ``LONG`` bytes are hashed by xxhash instead, as polynomials to a power of
two have known collisions between long, contrived words.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

_rng = np.random.default_rng(20240607)
VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: as VALUES, with A-Z taken as a-z
LOWER_VALUES = VALUES.copy()
LOWER_VALUES[65:91] = VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LONG, CHUNK = 512, 1 << 19
BASE = 0x9E3779B97F4A7C15
_AFTER = re.compile(rb"[\x20\x09-\x0d]")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_UP = _powers(BASE, 2 * CHUNK + 1)
_DOWN = _powers(pow(BASE, -1, 1 << 64), 2 * CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(data: bytes, values: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    space = SPACE[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[codes] * _UP[: len(codes)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG):
        hashes[i] = _long(data[starts[i] : ends[i]], values)
    return hashes


def _long(word: bytes, values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(word.lower() if values is LOWER_VALUES else word)


def hash_words(data: bytes, lower: bool = False) -> np.ndarray:
    """The hash of each word in order; ``lower``: A-Z as a-z."""
    values = LOWER_VALUES if lower else VALUES
    if len(data) <= CHUNK:
        return _hash_chunk(data, values)
    out, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            found = _AFTER.search(data, end)
            end = found.start() if found else len(data)
        piece = data[at:end]
        if len(piece) <= 2 * CHUNK:
            out.append(_hash_chunk(piece, values))
        else:  # a word of its own length class stands in it
            out.append(np.array([_long(w, values) if len(w) > LONG else _hash_chunk(w, values)[0] for w in piece.split()], np.uint64))
        at = end
    return np.concatenate(out)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` consecutive words; none with fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(BASE) + hashes[j : j + n]
    return mix(total)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of all words, marked as being of a whole text."""
    total = 0x5EED
    for h in hashes.tolist():
        total = (total * BASE + h) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([total + len(hashes)], np.uint64))
