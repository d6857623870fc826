"""Words, lines and shingles of whole Arrow text batches as numpy arrays.

All functions work on the UTF-8 bytes of many texts at once. A text is never
cut: a batch is split between texts only, so memory follows the longest text
plus ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time (more only if one text alone is longer).
PIECE = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_WORD_BASE = np.array([pow(0xD1342543DE82EF95, i, 2**64) for i in range(64)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Bytes and limits of consecutive texts."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        self.data, self.limits, self.n = data, limits, len(limits) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word."""
        word = ~IS_SPACE[self.data]
        if not len(word):
            return (np.zeros(0, np.int64),) * 3
        first = np.concatenate([[False], word[:-1]])
        inner = self.limits[(self.limits > 0) & (self.limits < len(word))]
        first[inner] = False
        last = np.concatenate([word[1:], [False]])
        last[inner - 1] = False
        starts = np.flatnonzero(word & ~first)
        ends = np.flatnonzero(word & ~last) + 1
        return starts, ends, np.searchsorted(self.limits, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        up, down = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, texts); a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(limits, limits[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, Texts(data[limits[row] : limits[stop]], limits[row : stop + 1] - limits[row])
        row = stop


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a text, and the number of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * _WORD_BASE[i]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[at]), at


def shingle_sets(texts: Texts, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and their limits by text.

    Words are compared with A-Z lower-cased. A text with fewer than ``size``
    words has its whole sequence as one shingle; one without words has none.
    """
    starts, ends, doc = texts.words()
    hashed = texts.hashes(starts, ends, lower=True)
    values, at = windows(hashed, doc, size)
    owner = doc[at]
    count = np.bincount(doc, minlength=texts.n)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        begin = np.concatenate([[0], np.cumsum(count)])
        whole = np.zeros(len(few), np.uint64)
        for i in range(size - 1):
            has = count[few] > i
            whole[has] += hashed[begin[few[has]] + i] * _WORD_BASE[i + size]
        whole = mix(whole + count[few].astype(np.uint64))
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    limits = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts.n))])
    for a, b in zip(limits[:-1], limits[1:]):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    if len(values) > 1:
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    kept = np.bincount(owner[new], minlength=texts.n)
    return values[new], np.concatenate([[0], np.cumsum(kept)])
