"""Vectorised words, word hashes and shingles over whole Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Longs of a packed stretch; SHORT bytes fit, as the last byte holds the length.
LONGS = 3
SHORT = 8 * LONGS - 1
#: Masks of the first 0 to 8 bytes of a little-endian long.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Odd multipliers; any odd values serve.
_ODD = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xD6E8FEB86659FD93], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def packed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """LONGS longs for each stretch raw[start:end] of at most SHORT bytes: its bytes and its length, so equal longs are equal stretches.

    Of a longer stretch the first SHORT bytes are packed, with a length of SHORT + 1.
    """
    held = np.zeros(len(raw) + 8 * LONGS, np.uint8)
    held[: len(raw)] = raw
    words = np.ndarray((len(raw) + 8 * LONGS - 7,), "<u8", held, 0, (1,))
    size = np.minimum(end - start, SHORT + 1)
    out = [words[start + 8 * k] & _FIRST[np.clip(size - 8 * k, 0, 8 if k < LONGS - 1 else 7)] for k in range(LONGS)]
    out[-1] |= size.astype(np.uint64) << np.uint64(56)
    return out


def folded(longs: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of packed stretches."""
    h = mixed(longs[0] * _ODD[0])
    for x, odd in zip(longs[1:], _ODD[1:], strict=True):
        h = mixed(h ^ (x * odd))
    return h


class Words:
    """Words of a string column: start and end bytes, hashes (A-Z lower-cased), and each document's first word (first has one entry more)."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = utf8(column)
        head = np.zeros(len(self.raw) + 1, dtype=bool)
        head[self.offsets] = True
        self._bounded(~_SPACE[self.raw], head)
        self.hash = self._hashed(_LOWER[self.raw])

    def _bounded(self, solid: np.ndarray, head: np.ndarray) -> None:
        """Words are runs of solid bytes; head marks where one ends at the latest and another begins."""
        n = len(solid)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | head[:n]))
        self.end = np.flatnonzero(solid & (~after | head[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def _hashed(self, raw: np.ndarray) -> np.ndarray:
        h = folded(packed(raw, self.start, self.end))
        for i in np.flatnonzero(self.end - self.start > SHORT).tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[self.start[i] : self.end[i]].data)
        return h

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def shingles(self, k: int) -> list[np.ndarray]:
        """Each document's distinct k-word shingles as sorted 64-bit hashes; shorter texts are one shingle; none without words."""
        h, first = self.hash, self.first
        weigh = [mixed(np.array([i + 1], dtype=np.uint64))[0] | np.uint64(1) for i in range(k + 1)]
        whole = np.zeros(0, np.uint64)
        if len(h) >= k:
            total = h[: len(h) - k + 1] * weigh[0]
            for i in range(1, k):
                total = total + h[i : len(h) - k + 1 + i] * weigh[i]
            whole = mixed(total)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                out.append(mixed((h[a:b] * np.array(weigh[: b - a], dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64) ^ weigh[b - a]))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
