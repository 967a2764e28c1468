"""Hashes of words and shingles over byte arrays."""

from __future__ import annotations

import numpy as np

_K = np.uint64
#: The multipliers of the public-domain murmur3 finaliser.
_M1, _M2 = _K(0xFF51AFD7ED558CCD), _K(0xC4CEB9FE1A85EC53)
#: Odd, hence with an inverse modulo 2^64.
_P = 0x9E3779B97F4A7C15
_PLACE = [_K(pow(_P, k + 3, 1 << 64)) for k in range(8)]
BLOCK = 1 << 18
WIDTH = 5

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
#: Characters that the license scan takes as separators: all of ASCII but letters and digits.
_mark = np.ones(256, bool)
_mark[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _mark[_a:_b] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _K(33))
    x *= _M1
    x ^= x >> _K(33)
    x *= _M2
    x ^= x >> _K(33)
    return x


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """p^i and p^-i, as long as was asked for."""

    up = down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, BLOCK + 1024)
            self.up, self.down = _powers(_P, n), _powers(pow(_P, -1, 1 << 64), n)
        return self.up, self.down


powers = _Powers()


def word_hashes(data: memoryview | bytes, separators: np.ndarray = _space, spans: bool = False):
    """A 64-bit hash of each word of a text in UTF-8, A-Z in lower case; with spans also the words' bounds.

    The text goes through in blocks that end at separators, so memory follows the words.
    """
    buf = np.frombuffer(data, np.uint8)
    out, begins, ends = [], [], []
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + BLOCK)
        while to < n and not separators[buf[to]]:
            to += 1
        b = buf[at:to]
        inside = np.empty(len(b) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = ~separators[b]
        d = np.diff(inside)
        s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        if len(s):
            up, down = powers.get(len(b) + 1)
            h = np.empty(len(b) + 1, np.uint64)
            h[0] = 0
            np.cumsum((_lower[b].astype(np.uint64) + _K(1)) * up[: len(b)], out=h[1:])
            out.append(mix((h[e] - h[s]) * down[s] + (e - s).astype(np.uint64) * _PLACE[7]))
            if spans:
                begins.append(s + at)
                ends.append(e + at)
        at = to
    cat = lambda x, t: np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, t)
    return (cat(out, np.uint64), cat(begins, np.int64), cat(ends, np.int64)) if spans else cat(out, np.uint64)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash of each run of width words, in order; fewer words make one."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix((words * np.array(_PLACE[:n], np.uint64)).sum(keepdims=True) + _K(n) * _PLACE[6])
    x = words[: n - width + 1] * _PLACE[0]
    for k in range(1, width):
        x += words[k : n - width + 1 + k] * _PLACE[k]
    return mix(x)


def shingle_set(data: memoryview | bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    return np.unique(shingles(word_hashes(data), width))
