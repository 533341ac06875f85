"""Hashes of words and word n-grams over Arrow text buffers, without a Python object for each word.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D). A prefix sum of byte codes times powers
of an odd number modulo 2**64 gives each word's polynomial hash from two look-ups; n-grams of words are hashed in
the same way from the word hashes. A final mix spreads the bits. 64 bits: two different n-grams of one comparison
collide with a chance of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Of some documents: hash of each word, its bytes' start and end in buf, and where each document's words begin (first)."""

    def __init__(self, buf: np.ndarray, edges: np.ndarray, lower: bool):
        ns = ~_SPACE[buf]
        inner = edges[(edges > 0) & (edges < len(buf))]
        before = np.zeros(len(buf), bool)
        before[1:] = ns[:-1]
        before[inner] = False
        after = np.zeros(len(buf), bool)
        after[:-1] = ns[1:]
        after[inner - 1] = False
        self.buf = buf
        self.start = np.flatnonzero(ns & ~before)
        self.end = np.flatnonzero(ns & ~after) + 1
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((_CODE_LOWER if lower else _CODE)[buf] * _pow(_P, len(buf)), out=total[1:])
        h = (total[self.end] - total[self.start]) * _pow(_PINV, len(buf) + 1)[self.start]
        self.hash = mix(h, 0x51)
        self.first = np.searchsorted(self.start, edges)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on (as many as words), and whether they lie within one document."""
        n = len(self.hash)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * _pow(_P, n), out=total[1:])
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * _pow(_PINV, n + 1)[: n - k + 1], 0xA7 + k)
        sizes = np.diff(self.first)
        room = np.repeat(self.first[1:], sizes) - np.arange(n)
        ok[:] = room >= k
        return out, ok

    def span(self, a: int, b: int, salt: int) -> int:
        """Hash of the words a to b - 1 as one sequence."""
        h = self.hash[a:b]
        return int(mix(np.array([(h * _pow(_P, len(h))).sum(dtype=np.uint64)], np.uint64), salt + len(h))[0])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all the texts (null: none), and the edges between them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, edges - edges[0]


def chunks(texts: pa.Array, lower: bool, limit: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) of runs of rows of about `limit` bytes, one row at least."""
    buf, edges = text_buffer(texts)
    a, n = 0, len(edges) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + limit, "right")) - 1)
        yield a, b, Words(buf[edges[a] : edges[b]], edges[a : b + 1] - edges[a], lower)
        a = b
