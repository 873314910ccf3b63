"""Word shingles of texts as sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Text is hashed in blocks of about this many bytes, so that memory doesn't follow the longest text.
BLOCK = 1 << 19

#: A-Z to a-z; the six separators (space and 0x09-0x0D) to a space; other bytes as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_RADIX = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix modulo 2^64, and of its inverse, for every place in a block."""
    n = BLOCK + (BLOCK >> 1)
    up = np.full(n, _RADIX, dtype=np.uint64)
    down = np.full(n, pow(_RADIX, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block_words(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of a folded block."""
    a = np.frombuffer(block, dtype=np.uint8)
    word = a != 32
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(a) > BLOCK + (BLOCK >> 1):  # one word of that size: its own powers
        up = np.full(len(a), _RADIX, dtype=np.uint64)
        down = np.full(len(a), pow(_RADIX, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    else:
        up, down = _powers()
    run = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=run[1:])
    h = (run[end] - run[begin]) * down[begin]
    return mixed(h + (end - begin).astype(np.uint64)), begin


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words begin; one more than there are texts)."""
    joined = b" ".join(texts).translate(FOLD)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    hashes, places = [], []
    at = 0
    while at < len(joined):
        end = min(len(joined), at + BLOCK)
        if end < len(joined):
            cut = joined.rfind(b" ", at, end)
            if cut <= at:
                cut = joined.find(b" ", end)
                cut = len(joined) if cut < 0 else cut
            end = cut
        h, begin = _block_words(joined[at:end])
        hashes.append(h)
        places.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    place = np.concatenate(places)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate(hashes), np.searchsorted(place, starts)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, which for hashes is many times faster than ``np.unique``'s table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _factors(words: int) -> np.ndarray:
    return mixed(np.arange(1, words + 2, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    hashes, begins = word_hashes(texts)
    factors = _factors(words)
    n = len(hashes)
    if n >= words:
        sums = np.zeros(n - words + 1, dtype=np.uint64)
        for k in range(words):
            sums += hashes[k : n - words + 1 + k] * factors[k]
        shingles = mixed(sums)
    out = []
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(distinct(shingles[lo : hi - words + 1]))
        elif hi > lo:
            parts = np.append(hashes[lo:hi], np.uint64(hi - lo)) * np.append(factors[: hi - lo], factors[words])
            out.append(mixed(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


@lru_cache(maxsize=4)
def _hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2)
    return a, b


def signature(shingles: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` minima of seeded multiply-shift hashes, as unsigned 32-bit numbers."""
    a, b = _hash_family(count, seed)
    low = np.full(count, np.uint64(_MASK))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(low, (part[:, None] * a[None, :] + b[None, :]).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")
