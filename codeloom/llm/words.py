"""Vectorised word hashing over UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Its hash is a
polynomial over 64-bit words with a random value per byte, taken for all words of a block at once
from one running sum. Blocks are about a megabyte, so memory doesn't follow a text's length beyond
eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_T = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_T[65:91] = _T[97:123]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if _powers[0].size < n:
        size = max(n, BLOCK + 65536)
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = ~_SPACE[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if buf.size and inside[0]:
        edges = np.concatenate(([0], edges))
    if buf.size and inside[-1]:
        edges = np.concatenate((edges, [buf.size]))
    return edges[0::2], edges[1::2]


def hashed(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [lo, hi)."""
    power, inverse = _power_tables(buf.size + 1)[:2]
    sums = np.empty(buf.size + 1, U)
    sums[0] = 0
    np.cumsum(_T[buf] * power[: buf.size], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(U))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Runs of whole texts of about BLOCK bytes, joined by line ends; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > BLOCK:
            yield first, i, b"\n".join(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts), b"\n".join(texts[first:])


def pieces(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Cuts at white space, of about BLOCK bytes; a longer word stays whole."""
    buf, at = np.frombuffer(data, np.uint8), 0
    while at < buf.size:
        end = min(buf.size, at + BLOCK)
        while end < buf.size:
            stop = np.flatnonzero(_SPACE[buf[end : end + 65536]])
            if stop.size:
                end += int(stop[0])
                break
            end = min(buf.size, end + 65536)
        yield at, buf[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order."""
    for first, last, data in blocks(texts):
        if last - first == 1:
            got = [hashed(buf, *spans(buf)) for _, buf in pieces(data)]
            yield np.concatenate(got) if got else np.empty(0, U)
            continue
        buf = np.frombuffer(data, np.uint8)
        lo, hi = spans(buf)
        h = hashed(buf, lo, hi)
        ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
        cuts = np.searchsorted(lo, ends)
        start = 0
        for stop in cuts:
            yield h[start:stop]
            start = stop


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
