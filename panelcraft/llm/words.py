"""Words and word hashes of Arrow text batches, without a Python loop over words.

A word is a longest run of bytes outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: ASCII letters and digits, and every byte of a non-ASCII character.  Word and
k-gram hashes are 64 bit and the same in every batch, task and session.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
GRAM = U(0xD6E8FEB86659FD93)
BLOCK_BYTES = 1 << 20


def _fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    separators = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
    t[separators] = 0
    return t


FOLD = _fold_table()
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, grown on demand."""
    if _POWERS["n"] < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _POWERS.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


@dataclass
class WordBlock:
    """The words of consecutive rows ``first .. first + rows - 1`` of a batch."""

    first: int
    rows: int
    low: np.ndarray  # folded bytes of the block, separators 0
    starts: np.ndarray  # byte start of every word, within the block
    ends: np.ndarray
    hashes: np.ndarray  # uint64 hash of every word
    bounds: np.ndarray  # words of row i: bounds[i] .. bounds[i + 1]
    offsets: np.ndarray  # bytes of row i: offsets[i] .. offsets[i + 1]
    total: np.ndarray  # running sum of byte * BASE**position

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()

    def words(self, i: int, j: int) -> bytes:
        """Words i .. j - 1 joined by single blanks (bytes between words are separators)."""
        return b" ".join(self.word(k) for k in range(i, j))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def word_row(self) -> np.ndarray:
        """The row (within the block) of every word."""
        return np.repeat(np.arange(self.rows), self.counts())

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first n bytes of every word that is longer than n bytes."""
        word = np.flatnonzero(self.ends - self.starts > n)
        at = self.starts[word]
        _, down = _powers(len(self.total))
        return word, mix((self.total[at + n] - self.total[at]) * down[at] + U(n << 32))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every k-gram that lies within one row."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = self.hashes[:n].copy()
        for j in range(1, k):
            h *= GRAM
            h += self.hashes[j : n + j]
        inside = np.arange(n) + k <= np.repeat(self.bounds[1:], self.counts())[:n]
        return np.flatnonzero(inside), mix(h[inside])


def word_blocks(col: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[WordBlock]:
    """Split a text column into blocks of rows of about ``block_bytes`` and find their words.

    A single longer text forms a block of its own, so memory follows the longest text.
    """
    data, offsets = text_bytes(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, "right")) - 1)
        j = min(j, n)
        yield _block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, j - i)
        i = j


def _block(raw: np.ndarray, offs: np.ndarray, first: int, rows: int) -> WordBlock:
    low = FOLD[raw]
    inside = low != 0
    n = len(low)
    cut = np.zeros(n + 1, bool)  # a word cannot continue across this byte boundary
    cut[offs] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(low.astype(U) * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    return WordBlock(first, rows, low, starts, ends, hashes, np.searchsorted(starts, offs), offs, total)


def words_hash(words: bytes) -> int:
    """The k-gram hash, as ``grams`` gives it, of folded words joined by single blanks."""
    block = _block(np.frombuffer(words, np.uint8), np.array([0, len(words)]), 0, 1)
    return int(block.grams(len(block.hashes))[1][0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
