"""64-bit hashes of the words and word n-grams of many texts at once, in array operations.

A word's hash is a polynomial over its bytes, taken as a difference of prefix sums modulo 2**64
and moved to position 0 by the multiplier's inverse; each byte first goes through a table of
64-bit values, and a finaliser spreads the result.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes that are hashed at a time; a longer span is hashed by itself.
ROUND_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FOLDED = _BYTES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_PLACES = mix(np.arange(1001, 1065, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_COUNTS = mix(np.arange(5001, 5065, dtype=np.uint64))

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def separators(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


#: The white space of words in the n-gram join.
SPACE = separators(b"\x20\x09\x0a\x0b\x0c\x0d")


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text where its words begin in those lists."""
    n = len(data)
    inside = ~gap[data]
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begin[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each span's bytes; starts and ends ascend. fold: as if A-Z were a-z."""
    table = _FOLDED if fold else _BYTES
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + ROUND_BYTES, "right")))
        n = int(ends[to - 1]) - low
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[low : low + n]] * powers(BASE, n), out=total[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[b] - total[a]) * powers(INVERSE, n + 1)[a] + (b - a).astype(np.uint64))
        at = to
    return out


def gram_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words within each text, and where each text's begin.

    A text of fewer words has its whole sequence as one run; one without words has none.
    first: where each text's words begin in words, and the end.
    """
    counts = np.diff(first)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(bounds[-1], np.uint64)
    long = counts >= size
    if long.any():
        full = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            full += words[k : k + len(full)] * _PLACES[k]
        keep = np.zeros(len(words) + 1, np.int64)
        np.add.at(keep, first[:-1][long], 1)
        np.add.at(keep, first[1:][long] - size + 1, -1)
        which = np.cumsum(keep[:-1])[: len(full)] > 0
        to = np.repeat(long, per)
        out[to] = mix(full[which] + _COUNTS[size])
    for i in np.flatnonzero(~long & (counts > 0)):
        w = words[first[i] : first[i + 1]]
        out[bounds[i]] = mix((w * _PLACES[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _COUNTS[len(w)])[0]
    return out, bounds
