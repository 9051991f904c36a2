"""Whole-batch text kernels on Arrow buffers.

An Arrow string column is one byte buffer plus offsets.  These kernels find
words, lines and n-grams of every text of a batch at once with numpy, so no
Python code runs per word.  Batches are cut into blocks of about ``BLOCK``
bytes at text boundaries, which bounds memory by the longest single text.

Hashes: each byte is replaced by a fixed random 64-bit value and summed with
powers of an odd base modulo 2**64; a span's hash is a difference of prefix
sums, shifted back to power 0, then mixed.  Equal spans have equal hashes
wherever they stand; different spans collide with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
ROWS = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[bool, np.ndarray] = {}

#: Bytes of ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are neither ASCII letters or digits nor part of a longer UTF-8 sequence.
NOT_ALNUM = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or of its inverse modulo 2**64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        base = np.uint64(pow(int(_BASE), -1, 2**64)) if inverse else _BASE
        have = np.ones(max(n, BLOCK + BLOCK // 2), np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if len(have) > 8 * BLOCK:  # a single huge text: do not keep its table
            return have[:n]
        _powers[inverse] = have
    return have[:n]


@dataclass
class Block:
    """Texts first .. first+n-1 of a batch: their bytes and offsets (from 0)."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def sums(self) -> np.ndarray:
        """Prefix sums of the position-weighted bytes."""
        out = np.zeros(len(self.buf) + 1, np.uint64)
        terms = _BYTE_VALUE[self.buf]
        terms *= powers(len(self.buf))
        np.cumsum(terms, out=out[1:])
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each span; empty spans hash alike."""
        sums = self.sums() if sums is None else sums
        raw = sums[end] - sums[start]
        raw *= powers(len(self.buf) + 1, True)[start]
        raw += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(raw)

    def runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text index) of the maximal runs of bytes that separate nothing."""
        inside = ~separator[self.buf]
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = self.off[:-1][np.diff(self.off) > 0]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[edge] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[edge[1:] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, self.text_of(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""(start, end, text index) of the \n-split lines; an empty text has one empty line."""
        cut = np.flatnonzero(self.buf == 10)
        owner = self.text_of(cut)
        start = np.concatenate([self.off[:-1], cut + 1])
        text = np.concatenate([np.arange(self.n), owner])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.ones(len(start), bool)
        last[:-1] = text[1:] != text[:-1]
        end[last] = self.off[1:][text[last]]
        return start, end, text

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1


def strings(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The texts of a string column (null: empty) in blocks of about ``limit`` bytes."""
    column = strings(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + ROWS, len(column))
        yield Block(i, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def grams(word: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of ``size`` words within a text."""
    m = len(word) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word[:m].copy()
    for k in range(1, size):
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h += word[k : k + m]
    keep = np.flatnonzero(text[:m] == text[size - 1 :])
    return mix(h[keep]), keep


def repeated(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A mask of the rows whose (group, key) occurs at least twice."""
    tag = mix(key ^ mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tag, kind="stable")
    same = np.zeros(len(tag), bool)
    same[:-1] = tag[order[1:]] == tag[order[:-1]]
    both = same.copy()
    both[1:] |= same[:-1]
    out = np.zeros(len(tag), bool)
    out[order] = both
    return out


def later(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A mask of the rows whose (group, key) also occurs in an earlier row."""
    tag = mix(key ^ mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tag, kind="stable")
    out = np.zeros(len(tag), bool)
    out[order[1:]] = tag[order[1:]] == tag[order[:-1]]
    return out


def count_in(group: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(group, weights, n).astype(np.int64)
