"""Hashed n-gram features of Arrow string batches (numpy)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import LOWER, WHITE, mix64, rows_of, span_hashes, text_blocks, word_spans

#: rows of one dense feature matrix
ROWS = 128


def _byte_grams(data: np.ndarray, off: np.ndarray, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-byte gram; grams do not cross texts."""
    if len(data) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.full(len(data) - n + 1, n, np.uint32)
    for k in range(n):
        code *= np.uint32(0x01000193)
        code ^= data[k:len(data) - n + 1 + k].astype(np.uint32) * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(13)
    bits = int(dims).bit_length() - 1
    bucket = (code >> np.uint32(32 - bits)).astype(np.int64)
    counts = np.maximum(np.diff(off) - n + 1, 0)
    inside = np.ones(len(bucket), bool)
    for k in range(1, n):  # starts in the last n - 1 bytes of a text
        at = off[1:] - k
        at = at[(at >= off[:-1]) & (at < len(inside))]
        inside[at] = False
    text = np.repeat(np.arange(len(off) - 1), counts)
    return text, bucket[inside]


def letter_grams(data: np.ndarray, off: np.ndarray, sizes: tuple[int, ...], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in sizes:
        yield _byte_grams(data, off, n, dims)


#: letters a-z and all non-ASCII bytes as they are, everything else one blank
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
LETTERS[65:91] = np.arange(97, 123)

_KIND = np.zeros(256, np.uint8)  # kinds of characters, for the shapes of words
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 4
for _k, _b in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_b] = 5 + _k


def shape_grams(data: np.ndarray, off: np.ndarray, dims: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the 1- to ``width``-grams of word shapes. A shape:
    kinds of the first, second and last character, length (up to 8), and
    whether the word equals the one before."""
    starts, ends = word_spans(data, off, WHITE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = rows_of(off, starts)
    hashes = span_hashes(LOWER[data], starts, ends)
    again = np.zeros(len(starts), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    kinds = _KIND[data]
    size = np.minimum(ends - starts, 8)
    shape = (((kinds[starts].astype(np.int64) * 64 + kinds[np.minimum(starts + 1, ends - 1)]) * 64
              + kinds[ends - 1]) * 16 + size) * 2 + again
    shape = mix64(shape.astype(np.uint64))
    text, bucket = [], []
    code = np.zeros(len(shape), np.uint64)
    for n in range(1, width + 1):
        code = code[:len(shape) - n + 1] * np.uint64(0x100000001B3) + shape[n - 1:]
        if not len(code):
            break
        whole = owner[:len(code)] == owner[n - 1:]
        text.append(owner[:len(code)][whole])
        bucket.append((mix64(code[whole]) % np.uint64(dims)).astype(np.int64))
    return np.concatenate(text), np.concatenate(bucket)


def row_blocks(texts: pa.Array, rows: int = ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of bounded bytes and at most ``rows`` texts."""
    for first, data, off in text_blocks(texts):
        for at in range(0, len(off) - 1, rows):
            own = off[at:at + rows + 1]
            yield first + at, data[own[0]:own[-1]], own - own[0]
