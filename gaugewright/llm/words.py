"""Words of texts as 128-bit digests, and hashes of runs of consecutive words, for many texts at once.

A word's digest is that of its bytes, so no arithmetic relation between words (repeats, swaps, lengths)
makes two of them alike. Runs are hashed by mixing halves, not by a sum over places, for the same reason.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from xxhash import xxh3_128_digest

#: Odd multipliers of the two halves of a run, and of its length; different ones for the two streams of hashes.
KEYS = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)),
    (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)),
)
#: Words whose digests are taken together.
BLOCK = 1 << 16


def split(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Runs:
    """Hashes of runs of consecutive numbers, which are digests.

    A run of 2^k numbers is made of its halves, one folded before it is multiplied; any run mixes those of
    the two runs of the largest 2^k that cover it, and its length.
    """

    def __init__(self, numbers: np.ndarray, stream: int = 0):
        self.levels, self.keys = [numbers], KEYS[stream]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            out = last[:-half] >> np.uint64(32)
            out ^= last[:-half]
            out *= self.keys[0]
            out += last[half:] * self.keys[1]
            self.levels.append(out)
        return self.levels[k]

    def covered(self, k: int, start, end, size) -> np.ndarray:
        """Hash of runs from start to end, whose length is at least 2^k and at most twice that."""
        x = self.level(k)
        if isinstance(size, int) and size == 1 << k:
            return mix(x[start])
        return mix(x[start] * self.keys[0] + x[end] * self.keys[1] + np.asarray(size, np.uint64) * self.keys[2])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each run from start up to but not including end; no run is empty."""
        size = end - start
        if not len(size):
            return np.zeros(0, np.uint64)
        least = int(size.min()).bit_length() - 1
        if int(size.max()) >> least == 1:
            return self.covered(least, start, end - (1 << least), size)
        out, power = np.zeros(len(size), np.uint64), np.frexp(size)[1] - 1
        for k in np.unique(power).tolist():
            some = power == k
            out[some] = self.covered(k, start[some], end[some] - (1 << k), size[some])
        return out

    def every(self, size: int) -> np.ndarray:
        """Hash of each run of `size`, of which there is one at least."""
        k = size.bit_length() - 1
        n = len(self.levels[0]) - size + 1
        return self.covered(k, slice(0, n), slice(size - (1 << k), size - (1 << k) + n), size)


def hashed(texts: list[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the digests of its words in order, as two rows of 64 bits. lower takes A-Z as a-z."""
    at = 0
    while at < len(texts):
        block, size = [], 0
        while at < len(texts) and (not block or size < BLOCK):
            data = texts[at].encode("utf-8", "surrogatepass") if texts[at] else b""
            block.append((data.lower() if lower else data).split())
            size += len(block[-1])
            at += 1
        found = np.frombuffer(b"".join(map(xxh3_128_digest, chain.from_iterable(block))), "<u8").reshape(-1, 2).T.copy()
        start = 0
        for words in block:
            yield found[:, start : start + len(words)]
            start += len(words)
