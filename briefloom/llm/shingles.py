"""Word shingles of many texts at once, as 64-bit hashes over a shared byte buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from briefloom.llm.common import mix64, text_bytes

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _odd(i: int) -> np.uint64:
    return mix64(np.array([i + 1], np.uint64))[0] | np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lower-cased, and the n + 1 offsets of words between texts."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & ~space)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, first[1:] | space[1:]
    ends = np.flatnonzero(last & ~space) + 1
    # Powers of an odd base wrap modulo 2**64 and have inverses, so a word's hash is a difference of two sums.
    power = np.full(len(data), BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    back = np.full(len(data), INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    words = (sums[ends] - sums[starts]) * back[starts]
    words = mix64(words + (ends - starts).astype(np.uint64) * _odd(99))
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, repeats included; a text of fewer words has its whole sequence as one."""
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += words[at + k] * _odd(k)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = counts[short] > k
        whole[has] += words[offsets[short[has]] + k] * _odd(k)
    whole += counts[short].astype(np.uint64) * _odd(50)
    return np.concatenate([text, short]), mix64(np.concatenate([total, whole]))


def shingle_sets(texts: pa.Array, size: int = 5, late: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text: hashes in a global order, sizes, and which are late.

    ``late`` holds sorted hashes and their ranks; late shingles come behind all others, by rank, and others by hash.
    """
    text, hashes = shingle_hashes(texts, size)
    rank = np.zeros(len(hashes), np.int64)
    if late is not None and len(late[0]):
        at = np.minimum(np.searchsorted(late[0], hashes), len(late[0]) - 1)
        rank = np.where(late[0][at] == hashes, late[1][at] + 1, 0)
    order = np.lexsort((hashes, text * (1 << 32) + rank))
    text, hashes, rank = text[order], hashes[order], rank[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[fresh], np.bincount(text[fresh], minlength=len(texts)), rank[fresh] > 0
