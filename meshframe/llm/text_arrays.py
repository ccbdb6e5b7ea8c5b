"""Numpy views of one text: words, their lengths and codes, and rolling hashes of n-grams.

Equal words and equal lines are found by their bytes (a dictionary gives each its number, and a
bijection makes it look random); equal n-grams by rolling hashes, whose hits are compared word by word."""

from __future__ import annotations

from itertools import count

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def numbered(items: list[bytes]) -> np.ndarray:
    """A 64-bit code for each item; equal for equal items only."""
    return mixed(np.fromiter(map({}.setdefault, items, count()), np.int64, len(items)))


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on by a bijection that makes them look random."""
    h = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, _BACK))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of codes[begin:end], all from one running sum."""
    up, down = _POWERS.upto(max(1, len(codes)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up)))
    h = (total[end] - total[begin]) * down[np.minimum(begin, len(down) - 1)]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class TextArrays:
    """Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]; lengths are in code points."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        b = self.bytes = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate(([False], ~SPACE[b], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edge[::2], edge[1::2]
        self.n_words = len(self.begin)
        self.first = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))  # code points before each byte
        self.chars = self.first[self.end] - self.first[self.begin]
        self.word_chars = int(self.chars.sum())

    def words(self) -> np.ndarray:
        """Code of each word."""
        return numbered(self.raw.split())

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, code points in words) of each line that has a word."""
        cut = np.concatenate(([-1], np.flatnonzero(self.bytes == 10), [len(self.bytes)]))
        a, b = cut[:-1] + 1, cut[1:]
        sums = np.concatenate(([0], np.cumsum(self.chars)))
        has = (n := np.searchsorted(self.begin, b)) > (m := np.searchsorted(self.begin, a))
        return numbered([line for line, h in zip(self.raw.split(b"\n"), has.tolist()) if h]), (sums[n] - sums[m])[has]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - n + 1))
    return span_hashes(words, at, at + n)


def repeated(hashes: np.ndarray, words: np.ndarray | None = None, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(marks of values that occur twice or more, marks of those that occurred before). With the words'
    codes, hashes are those of their n-grams, and equal ones are compared word by word."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    x, y = order[1:][same], order[:-1][same]
    if words is not None and not all((words[x + d] == words[y + d]).all() for d in range(n)):
        _, exact = np.unique(np.lib.stride_tricks.sliding_window_view(words, n), axis=0, return_inverse=True)
        return repeated(exact.ravel())
    twice, again = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    again[x] = True
    twice[x] = True
    twice[y] = True
    return twice, again


def covered(marks: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside a marked window of n words."""
    step = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(marks)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step[:-1]) > 0
