"""Codes of words, made on the bytes of many passages at once."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = 1
_KIND[128:] = 1
_KIND[list(b"!?")] = 2
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_powers = np.empty(0, np.uint64)
NUMBER, BANG = np.uint64(3), np.uint64(4)


def powers(n: int) -> np.ndarray:
    """The first ``n`` (or more) powers of the multiplier."""
    global _powers
    if n > len(_powers):
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(1 << max(8, n.bit_length()), ODD), dtype=np.uint64)
    return _powers


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for each pair of keys."""
    with np.errstate(over="ignore"):
        h = (a * ODD + b) ^ np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * ODD
        return h ^ (h >> np.uint64(29))


def hash_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of a lower-case text and the lines (from 0) that they stand in.

    Words are runs of letters, digits and inner apostrophes, and runs of
    ``!`` and ``?``; all numbers are one word, and so are all such marks.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    kind = _KIND[raw]
    # an apostrophe counts between two letters only
    quote = np.flatnonzero(raw == 39)
    if len(quote):
        before, after = kind[np.maximum(quote - 1, 0)] == 1, kind[quote + 1] == 1
        inner = before & after & (raw[np.maximum(quote - 1, 0)] != 39) & (raw[quote + 1] != 39) & (quote > 0)
        kind = kind.copy()
        kind[quote[~inner]] = 0
    change = np.flatnonzero(np.diff(np.concatenate(([0], kind))))
    size = np.diff(np.concatenate((change, [len(raw)])))
    what = kind[change] if len(change) else np.empty(0, np.uint8)
    begin, size, what = change[what > 0], size[what > 0], what[what > 0]
    if not len(begin):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(kind)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(raw[at].astype(np.uint64) * powers(int(size.max()))[place], first)
        h = (h ^ (h >> np.uint64(31))) * ODD
    h[np.logical_and.reduceat(_DIGIT[raw[at]], first)] = NUMBER
    h[what == 2] = BANG
    return h, np.searchsorted(np.flatnonzero(raw == 10), begin)
