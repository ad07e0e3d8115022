"""Words, word hashes and rolling window hashes, shared by operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

#: A worker forgets the hashes of words it has seen when they are so many.
CACHE_WORDS = 300_000

_U = np.uint64
#: Odd multipliers of the rolling polynomials, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def split_words(text: str | None) -> list[bytes]:
    """The UTF-8 words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole 64 bits."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Roller:
    """Rabin-Karp hashes of all windows of an array of word hashes, modulo 2**64.

    ``sum(h[j] * base**j)`` over a window is a difference of prefix sums; multiplying by the
    inverse power of the base makes it independent of where the window starts.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def windows(self, h: np.ndarray, width: int) -> np.ndarray:
        n = len(h)
        if n < width:
            return np.empty(0, _U)
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, self.base, _U)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, self.inverse, _U)]))
        sums = np.empty(n + 1, _U)
        sums[0] = 0
        np.cumsum(h * self.up[:n], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * self.down[: n - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from block-wise prefix and suffix minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])
