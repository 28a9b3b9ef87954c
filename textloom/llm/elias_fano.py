"""Elias-Fano lists: rising whole numbers in about two bits an element plus the logarithm of their mean gap.

A list is bytes: a header (count, low bits an element), the low bits end to end, then the high parts in unary, a one
for each element after as many zeros as the high part has risen. An element is read by finding its one.
"""

from __future__ import annotations

import numpy as np

_HEADER = np.dtype([("n", "<u4"), ("low", "<u4")])


def encode(values: np.ndarray) -> bytes:
    """Bytes of rising (not falling) values of at least 0."""
    values = np.asarray(values, np.int64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    header = np.array([(n, low)], _HEADER).tobytes()
    if not n:
        return header
    lows = (values[:, None] >> np.arange(low)) & 1
    highs = np.zeros((top >> low) + n, np.uint8)
    highs[(values >> low) + np.arange(n)] = 1
    return header + np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(highs, bitorder="little").tobytes()


def size(data: bytes) -> int:
    """Number of elements."""
    return int(np.frombuffer(data, _HEADER, 1)["n"][0])


def select(data: bytes, places: np.ndarray) -> np.ndarray:
    """The elements at these places, from 0: a count of ones by byte finds the byte, its bits the place in it."""
    header = np.frombuffer(data, _HEADER, 1)[0]
    n, low = int(header["n"]), int(header["low"])
    places = np.asarray(places, np.int64)
    if len(places) and not (0 <= places.min() and places.max() < n):
        raise IndexError("no such element")
    at = _HEADER.itemsize
    split = at + (n * low + 7) // 8
    highs = np.frombuffer(data, np.uint8, offset=split)
    ones = np.cumsum(np.bitwise_count(highs), dtype=np.int64)
    byte = np.searchsorted(ones, places, "right")
    rank = places - np.where(byte > 0, ones[byte - 1], 0)
    bits = np.unpackbits(highs[byte], bitorder="little").reshape(-1, 8)
    inside = np.argmax(np.cumsum(bits, axis=1) > rank[:, None], axis=1) if len(places) else places
    high = byte * 8 + inside - places
    if not low:
        return high
    lows = np.frombuffer(data, np.uint8, split - at, at)
    where = places[:, None] * low + np.arange(low)
    return (high << low) | (((lows[where >> 3] >> (where & 7)) & 1).astype(np.int64) << np.arange(low)).sum(axis=1)
