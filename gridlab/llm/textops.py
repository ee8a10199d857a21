"""Vectorised word and shingle hashing over Arrow string batches (numpy).

Texts of a batch stay one byte buffer with offsets, as Arrow holds them, so
that splitting and hashing cost a few array passes per byte instead of Python
work per word. Batches are cut into blocks of bounded size first; a single
text beyond the bound forms a block of its own and is never truncated.
"""
from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_U = np.uint64
_RNG = np.random.RandomState(20240229)
_BYTE_CODE = _RNG.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)

#: `[\x20\x09-\x0D]` separates words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    lo = int(offsets[0])
    return np.frombuffer(data, np.uint8, int(offsets[-1]) - lo, lo), offsets - lo


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of at most ``limit``
    bytes together, or of one longer row."""
    data, off = text_buffer(texts)
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, data[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: a Python worker
    is used again by later stages and would keep its highest mark."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_spans(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; spans are disjoint and in
    order, none empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    longest = int(size.max())
    power = np.full(longest, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    gapless = len(at) == len(data)
    value = _BYTE_CODE[data if gapless else data[np.repeat(starts, size) + at]] * power[at]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def rows_of(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text's index of each word start."""
    return np.searchsorted(off, starts, "right") - 1


def shingle_rows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows of all texts (a shorter text: its
    whole sequence as one) and the number of each text's windows. ``words``:
    all word hashes in order, ``counts``: words of each text."""
    n = len(words)
    weight = mix64(np.arange(1, width + 1, dtype=np.uint64))
    parts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), parts
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k:n - width + 1 + k] * (weight[k] | _U(1))
        rolled = mix64(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    first_word = np.concatenate(([0], np.cumsum(counts)[:-1]))
    first_part = np.concatenate(([0], np.cumsum(parts)[:-1]))
    total = int(parts.sum())
    at = np.repeat(first_word, parts) + np.arange(total) - np.repeat(first_part, parts)
    out = np.zeros(total, np.uint64)
    full = np.repeat(counts >= width, parts)
    out[full] = rolled[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = _U(counts[i])
        for w in words[first_word[i]:first_word[i] + counts[i]]:
            h = mix64(np.array([h * _U(31) + w], np.uint64))[0]
        out[first_part[i]] = h
    return out, parts


def text_shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of lower-cased (A-Z) white-space words, and their number
    in each text."""
    starts, ends = word_spans(data, off, WHITE)
    hashes = span_hashes(LOWER[data], starts, ends)
    counts = np.bincount(rows_of(off, starts), minlength=len(off) - 1) if len(starts) else np.zeros(len(off) - 1, np.int64)
    with np.errstate(over="ignore"):
        return shingle_rows(hashes, counts, width)
