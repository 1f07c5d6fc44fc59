"""Vectorised hashes of the bytes and words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

UNIT_BYTES = 1 << 20
# An odd multiplier has an inverse modulo 2**64, so a hash of a stretch of bytes is a
# difference of running sums, moved to the start of the stretch.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n; kept up to a bound."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        a, b = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        a[0] = b[0] = 1
        a, b = np.cumprod(a), np.cumprod(b)
        if size > 4 * UNIT_BYTES:
            return a[:n], b[:n]
        _powers, _inverses = a, b
    return _powers[:n], _inverses[:n]


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverses): ``(sums[e] - sums[s]) * inverses[s]`` is the hash of bytes s to e."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:-1], out=sums[1:])
    return sums, down


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its values."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.binary() else np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets


def units(offsets: np.ndarray, limit: int = UNIT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold up to ``limit`` bytes together, or one longer value."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, value number) of every word, in order; A-Z are lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWERED[data]
    blank = SPACES[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~blank & edge[:-1]
    start[1:] |= ~blank[1:] & blank[:-1]
    end = ~blank & edge[1:]
    end[:-1] |= ~blank[:-1] & blank[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums, down = running(low)
    hashes = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return hashes, np.searchsorted(offsets, s, "right") - 1


UNIT_VALUES = 512
HASH_BITS = 55  # a set's hashes share a 64-bit word with the value's number in its unit
_DROPPED = np.uint64(64 - HASH_BITS)


def sorted_per_value(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Value number and hash in one word, sorted; one sort serves all values of a unit."""
    words = (of.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> _DROPPED)
    words.sort()
    return words


def hash_of(words: np.ndarray) -> np.ndarray:
    return words & np.uint64((1 << HASH_BITS) - 1)


def value_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(HASH_BITS)).astype(np.int64)


def shingle_units(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first value, bounds, hashes): the distinct hashes of the runs of ``width`` words of each value, sorted.

    Value ``first + i`` has ``hashes[bounds[i]:bounds[i + 1]]``. A value with fewer words has one
    hash, of all of them; without words it has none.
    """
    data, offsets = raw(column)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for a, b in units(offsets):
        for a in range(a, b, UNIT_VALUES):
            last = min(b, a + UNIT_VALUES)
            w, of = word_hashes(data[offsets[a] : offsets[last]], offsets[a : last + 1] - offsets[a])
            counts = np.bincount(of, minlength=last - a)
            ends = np.cumsum(counts)
            runs = np.zeros(max(0, len(w) - width + 1), np.uint64)
            for k in range(width):
                runs += w[k : k + len(runs)] * factors[k]
            whole = of[: len(runs)] == of[len(w) - len(runs) :]
            runs, run_of = mix(runs[whole]), of[: len(runs)][whole]
            few = np.flatnonzero((counts > 0) & (counts < width))
            if len(few):
                short = [
                    mix((w[ends[i] - counts[i] : ends[i]] * factors[: counts[i]]).sum(keepdims=True) + np.uint64(counts[i]))
                    for i in few
                ]
                runs, run_of = np.concatenate([runs, *short]), np.concatenate([run_of, few])
            words = sorted_per_value(runs, run_of)
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            words = words[new]
            yield a, np.searchsorted(value_of(words), np.arange(last - a + 1)), hash_of(words)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    for _, bounds, hashes in shingle_units(column, width):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield hashes[a:b]


def signatures(bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that name each value's set; zero for an empty one."""
    out = []
    for scrambled in (mix(hashes + np.uint64(1)), mix(hashes ^ np.uint64(BASE))):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled)))
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
    return out[0], out[1]
