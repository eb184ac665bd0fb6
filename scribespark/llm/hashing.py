"""64-bit hashes of words and word shingles, over whole buffers of text at a time."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = bytes(i in (9, 10, 11, 12, 13, 32) for i in range(256))
_LOWER = bytes(i + 32 * (65 <= i < 91) for i in range(256))
#: The first bytes of a block of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed as a polynomial of their bytes, not eight bytes at a time.
_LONG = 256

#: Longest table of powers that a worker keeps.
_KEPT = 1 << 19

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x))]) for x in (_BASE, _BASE_INVERSE))
    if n <= _KEPT:
        _powers = made
    return made


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text, A-Z lower-cased, and the bytes they start at.

    Words are runs of anything but blank and \\t to \\r. All words take in their next eight bytes in one step; the
    first step is a bijection of a word's length and bytes, so words of up to eight bytes and one length never meet.
    """
    padded = b" " + text + b" " * 8
    lower = np.frombuffer(padded.translate(_LOWER), np.uint8)
    space = np.frombuffer(padded.translate(_SPACE), np.uint8)
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    blocks = np.ndarray((len(lower) - 8,), "<u8", lower, 1, (1,))
    words = mixed((blocks[start] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _BASE))
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    done = 8
    while len(more):
        block = blocks[start[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]
        words[more] = mixed(words[more] * _STEP + block)
        done += 8
        more = more[size[more] > done]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        words[long] = _polynomials(lower[1:], start[long], edges[1::2][long])
    return words, start


def _polynomials(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A running sum of bytes times powers gives each word's polynomial in one subtraction."""
    up, down = _powers_to(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mixed((sums[end] - sums[start]) * down[start])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (see ``hashed``), and where each text's words end."""
    words, start = hashed(b" ".join(texts))
    return words, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words; of all words at once where there are fewer, of none where none."""
    n = min(n, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * _STEP + words[k : len(words) - n + 1 + k]
    return mixed(total + np.uint64(n))


def elements(hashes: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th copy of a hash becomes an element of its own. Sorted by hash."""
    hashes = np.sort(hashes)
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    at = np.arange(len(hashes))
    copy = at - np.maximum.accumulate(np.where(first, at, 0))
    return cell(hashes, copy.astype(np.uint64))


def cell(hashes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The element that stands for the weights from k to k + 1 of a hash."""
    return mixed(hashes + k * _STEP)


def regions(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted hashes (distinct ones) as cells of one unit of weight, and how far each is filled: 1, or less in the last."""
    whole = np.ceil(weights).astype(np.int64)
    of = np.repeat(np.arange(len(hashes)), whole)
    k = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    return cell(hashes[of], k.astype(np.uint64)), np.minimum(1.0, weights[of] - k)
