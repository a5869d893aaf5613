"""Unsigned LEB128 in its shortest form, one number or an array at a time."""

from __future__ import annotations

import numpy as np

from lamella.errors import InvalidVarint, UnexpectedEof

_U = np.uint64


def write_one(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_one(data: bytes | memoryview, at: int = 0) -> tuple[int, int]:
    """The number at a place, and the place behind it."""
    value = shift = 0
    start = at
    while True:
        if at >= len(data):
            raise UnexpectedEof if at == start or shift < 64 else InvalidVarint
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            if (byte == 0 and shift) or value >= 1 << 64:
                raise InvalidVarint
            return value, at
        shift += 7
        if shift > 63:
            raise InvalidVarint


def write_many(values: np.ndarray) -> bytes:
    values = np.asarray(values).astype(np.uint64)
    if not len(values):
        return b""
    if values.max() < 0x80:
        return values.astype(np.uint8).tobytes()
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= _U(1 << (7 * k))
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(values)), sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    out = ((values[which] >> (place * 7).astype(np.uint64)) & _U(0x7F)).astype(np.uint8)
    out[place < sizes[which] - 1] |= 0x80
    return out.tobytes()


def read_many(data: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """So many numbers from the beginning of an array of bytes, and how many bytes they take."""
    if not count:
        return np.zeros(0, np.uint64), 0
    ends = np.flatnonzero(data < 0x80)
    if len(ends) < count:
        raise UnexpectedEof
    ends = ends[:count] + 1
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    used = int(ends[-1])
    if used == count:
        return data[:count].astype(np.uint64), used
    last = data[ends - 1]
    if (sizes > 10).any() or ((sizes > 1) & (last == 0)).any() or ((sizes == 10) & (last > 1)).any():
        raise InvalidVarint
    place = np.arange(used) - np.repeat(starts, sizes)
    parts = (data[:used].astype(np.uint64) & _U(0x7F)) << (place * 7).astype(np.uint64)
    return np.add.reduceat(parts, starts), used
