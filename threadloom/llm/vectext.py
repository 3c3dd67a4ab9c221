"""Vectorised word and n-gram arithmetic on blocks of texts.

A block is one byte buffer of all texts in UTF-8, each followed by a line feed. Words are runs of
bytes other than space and \\x09-\\x0D, so byte positions suffice: no such byte is part of a longer
UTF-8 sequence. Hashes are 64-bit; sums wrap.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            table = np.full(n, base, U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Block:
    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(raw)
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        #: bounds[i] .. bounds[i + 1] are the bytes of text i with its line feed
        self.total: np.ndarray | None = None
        self.bounds = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw]))).astype(np.int64)

    def words(self, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words: runs of bytes that the table doesn't mark (it marks the line feed)."""
        space = table[self.buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        return edge[::2], edge[1::2]

    def doc_of(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text of each (ascending) byte position, and how many lie in each text."""
        cut = np.searchsorted(positions, self.bounds)
        counts = np.diff(cut)
        return np.repeat(np.arange(self.n), counts), counts

    def prefix(self) -> np.ndarray:
        p, _ = powers(len(self.buf))
        return np.concatenate((np.zeros(1, U), np.cumsum((self.buf.astype(U) + U(1)) * p[: len(self.buf)], dtype=U)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each range; equal bytes have equal hashes at any place."""
        if self.total is None:
            self.total = self.prefix()
        total, (_, inverse) = self.total, powers(len(self.buf))
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


#: Odd multipliers, one for each place of an n-gram.
PLACES = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbouring words of one text, and the index of the first word of each."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(h) - n + 1
    total = np.zeros(m, U)
    for k in range(n):
        total += h[k : k + m] * PLACES[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(total[at] + U(n)), at


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; 0 for an empty run."""
    out = np.zeros(len(counts), values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out
