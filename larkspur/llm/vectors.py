"""Whole-batch text primitives in numpy: blocks of rows, words, and hashes of any byte range.

All of them work on the bytes of many rows at once, so no operator loops over characters or words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: 64 random-looking bits for each byte value.
SYMBOLS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that are separated by white space only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Block(NamedTuple):
    """Rows lo to hi of a batch: their bytes one after the other, and where each begins (one more at the end)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def release() -> None:
    """Gives freed memory back to the system: executors keep Python workers from one stage to the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Block]:
    """Views of a string or binary column of about `limit` bytes each; a longer row is a block of its own. Null is empty."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    release()


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Ranges:
    """64-bit hashes of arbitrary ranges of bytes, or of 64-bit hashes, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        terms = SYMBOLS[data] if data.dtype == np.uint8 else data.copy()
        terms *= _power(_BASE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate(terms, out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(data) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.inverse[starts]
        return mix(out + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of the `width` bytes from each position on."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.inverse[: len(out)]
        return mix(out)


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each row, the index of its first word; one more at the end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes that the table marks; they never cross rows."""
    mask = table[data]
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return Words(starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, limit: int = 1 << 21, lower: bool = True) -> tuple[Words, np.ndarray]:
    """The words of rows, after A-Z are lowered or as they are, and a 64-bit hash of each.

    Data beyond `limit` bytes, as of a very long row, are read in pieces that end between words, so that what is
    held besides words and hashes follows the limit.
    """
    fold = LOWER if lower else np.arange(256, dtype=np.uint8)
    starts, ends, hashes, lo = [], [], [], 0
    while True:
        hi = len(data)
        if hi - lo > limit:
            gap = np.flatnonzero(~table[fold[data[lo : lo + limit]]])
            hi = lo + int(gap[-1]) + 1 if len(gap) else lo + limit
            while not len(gap) and hi < len(data):  # one word of more than `limit` bytes
                gap = np.flatnonzero(~table[fold[data[hi : hi + limit]]])
                hi = hi + int(gap[0]) + 1 if len(gap) else min(hi + limit, len(data))
        some = fold[data[lo:hi]]
        inside = offsets[(offsets > lo) & (offsets < hi)] - lo
        w = words(some, np.concatenate([[0], inside, [hi - lo]]), table)
        starts.append(w.starts + lo)
        ends.append(w.ends + lo)
        if len(w.starts):
            hashes.append(Ranges(some).hash(w.starts, w.ends))
        lo = hi
        if lo >= len(data):
            break
    starts = np.concatenate(starts)
    return Words(starts, np.concatenate(ends), np.searchsorted(starts, offsets)), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[pa.Table]:
    """Sorted rows in tables of about `rows` rows that end between groups, which the first `keys` columns, numbers, tell apart."""
    held, have = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        have += b.num_rows
        if have < rows:
            continue
        now = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([now.column(j).to_numpy() for j in range(keys)], 1)
        change = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        cut = int(change[-1]) if len(change) else 0
        before = 0
        for at in change[np.searchsorted(change, np.arange(rows, cut, rows))].tolist() + [cut] if cut else []:
            if at > before:
                yield now.slice(before, at - before)
                before = at
        held = now.slice(cut).to_batches()
        have = now.num_rows - cut
    if have:
        yield pa.Table.from_batches(held).combine_chunks()
