"""Vectorised word statistics over a block of texts: word bounds, 64-bit word and window hashes.

A span's hash is a difference of prefix sums of byte codes times powers of an odd base, modulo 2**64, brought to
position 0 by the base's inverse and mixed. Equal spans have equal hashes; of n different ones about n**2 / 2**65 pairs
collide.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240117))
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: White space of the word pattern: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def distinct(a: np.ndarray) -> np.ndarray:
    """The sorted different values; sorting is several times faster here than the library's hash table."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the largest table asked for so far is kept, up to 4 Mi entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], mixed with the length."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * powers(_BASE, len(data)), out=sums[1:])
    back = powers(_INVERSE, len(data) + 1)[starts]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


class Words:
    """Words of a block of texts: byte bounds, hashes and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~IS_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        bounds = offsets[:-1][offsets[:-1] < len(data)]
        first[bounds] = inside[bounds]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        bounds = offsets[1:][offsets[1:] > 0] - 1
        last[bounds] = inside[bounds]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Row i has the words of_row[i] to of_row[i + 1].
        self.of_row = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.of_row)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def room(self, n: int) -> np.ndarray:
        """For each word, whether n words from it on lie in the same text."""
        return np.arange(len(self.starts)) + n <= self.of_row[1:][self.row]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each word on; the last n - 1 entries are not windows and hold 0."""
    out = np.zeros(len(hashes), np.uint64)
    if n <= len(hashes):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
        out[: len(hashes) - n + 1] = mix((sums[n:] - sums[:-n]) * powers(_INVERSE, len(hashes))[: len(hashes) - n + 1])
    return out
