"""Hashes of words and word shingles of many texts at once, with numpy.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
#: The same for RE2.
WORD_RE2 = r"[0-9a-z\x{80}-\x{10FFFF}]+"
SHINGLE = 5
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(n: int, seed: int = 0) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_VALUES, _PLACES = series(256, 1), series(SHINGLE, 2) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        n = 1 << max(20, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _UNBASE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each text's first word, with the number of words at the end)."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    inside = _IS_WORD[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    up, down = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    at = np.cumsum([0, *(len(r) + 1 for r in raw)]) + 1
    return hashes, np.searchsorted(start, at)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of five words, or of ``size`` up to five; shorter input has none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _PLACES[0]
    for k in range(1, size):
        total += words[k : k + n] * _PLACES[k]
    return mix(total)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts, place of each text's first shingle, with their number at the end)."""
    words, at = word_hashes(texts)
    every = shingle_hashes(words)
    counts = np.maximum(np.diff(at) - SHINGLE + 1, 0)
    ends = np.cumsum(counts)
    first = np.concatenate([[0], ends])
    place = np.repeat(at[:-1] - first[:-1], counts) + np.arange(ends[-1] if len(ends) else 0)
    return every[place] if len(place) else np.empty(0, np.uint64), first


def slices(lengths: list[int], most: int) -> list[range]:
    """Ranges of rows that hold about ``most`` characters together, one row at least."""
    out, begin, held = [], 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > most:
            out.append(range(begin, k))
            begin, held = k, 0
        held += n
    if begin < len(lengths):
        out.append(range(begin, len(lengths)))
    return out
