"""Vectorised hashes of words and byte runs: prefix sums modulo 2^64, so any run's hash is a difference."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import per_process

_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered pair of hashes as one."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def _letters(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD[lane]))


#: Bytes that share one run of powers; longer rows get a longer run.
_SEGMENT = 1 << 18


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, 0 to n - 1 at least; kept per process."""
    size = 1 << max(19, int(n).bit_length())

    def build():
        base = _ODD[lane]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    return per_process(f"powers:{lane}:{size}", build)


class RunHashes:
    """Hashes of byte runs that stay within a row of a block; ``lane`` picks one of two independent functions."""

    def __init__(self, body: np.ndarray, at: np.ndarray, lane: int = 0):
        # Powers start anew at some row starts, so tables and temporary arrays stay small.
        starts = [0]
        for k in np.searchsorted(at, np.arange(_SEGMENT, len(body), _SEGMENT), "right") - 1:
            if at[k] > starts[-1]:
                starts.append(int(at[k]))
        self.starts = np.array(starts)
        ends = np.append(self.starts[1:], len(body))
        up, self.down = _powers(lane, int((ends - self.starts).max()) + 1)
        letters = _letters(lane)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        for a, b in zip(self.starts, ends):
            np.multiply(letters[body[a:b]], up[: b - a], out=self.sums[a + 1 : b + 1])
        np.cumsum(self.sums, out=self.sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs in ascending order of their starts."""
        within = start
        if len(self.starts) > 1:
            cut = np.append(np.searchsorted(start, self.starts), len(start))
            within = start - np.repeat(self.starts, np.diff(cut))
        return mix((self.sums[end] - self.sums[start]) * self.down[within] + (end - start).astype(np.uint64))


#: Positions of a word whose factors are kept per process.
_KEPT_FACTORS = 1 << 16


def _factors(n: int) -> np.ndarray:
    make = lambda size: mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_ODD[1]) ^ np.uint64(_ODD[0]))
    return per_process("factors", lambda: make(_KEPT_FACTORS)) if n <= _KEPT_FACTORS else make(n)


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of which none overlaps another, in ascending order.

    Each place in a run has a factor of its own that follows no rule, so there are no two texts that collide by
    construction, as there are for powers of one base modulo 2^64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    ahead = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(ahead, size)
    terms = _letters(0)[body[within + np.repeat(start, size)]] * _factors(int(size.max()))[within]
    return mix(np.add.reduceat(terms, ahead) + mix(size.astype(np.uint64)))


# The white space of the word rule, \x20 and \x09 to \x0D.
WHITE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def lower_ascii(body: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[body]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that stay within a row: start, end, and the first run of each row (n + 1 numbers)."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)
