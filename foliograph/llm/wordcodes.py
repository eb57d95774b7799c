"""Words of whole batches of texts as numpy arrays, without a Python object per word."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _alnum_table() -> np.ndarray:
    """For every code point whether it is a letter or digit."""
    flags = np.zeros(sys.maxunicode + 1, bool)
    flags[[c for c in range(sys.maxunicode + 1) if chr(c).isalnum()]] = True
    return flags


_ALNUM: np.ndarray | None = None


def alnum() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = _alnum_table()
    return _ALNUM


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def codepoints(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case texts end to end, a line feed after each, and where each begins (one more entry at the end)."""
    low = [(t or "").lower() for t in texts]
    flat = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(low) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)), out=bounds[1:])
    return flat, bounds


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, bounds, start, stop, first)``: the batch's code points and text bounds, where each word begins and
    ends, and the number of each text's first word (one more entry at the end). A word is a run of letters and digits.
    """
    codes, bounds = codepoints(texts)
    inside = alnum()[codes]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, stop = edge[::2], edge[1::2]
    return codes, bounds, start, stop, np.searchsorted(start, bounds)


_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate((np.ones(1, _U), np.cumprod(np.full(max(n, 1 << 20), x, _U)))) for x in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every batch: a polynomial of its scrambled code points, from running sums
    over the whole batch, so that words of any length cost the same per character."""
    if not len(start):
        return np.zeros(0, _U)
    up, down = _powers(len(codes))
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(mix(codes.astype(_U) + _BASE) * up, out=total[1:])
    return mix((total[stop] - total[start]) * down[start] ^ (stop - start).astype(_U))


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shingle, first)``: hashes of each text's distinct sequences of ``size`` consecutive words, sorted within the text, and where
    each text's begin (one more entry at the end)."""
    texts = len(first) - 1
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(texts + 1, np.int64)
    s = np.zeros(n, _U)
    for i in range(size):
        s = (s * _BASE) ^ h[i : i + n]
        s ^= s >> _U(31)
    s = mix(s)
    owner = np.repeat(np.arange(texts), np.diff(first))
    inside = owner[:n] == owner[size - 1 :]
    s, owner = s[inside], owner[:n][inside]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(texts + 1))


def slices(texts: list[str | None], most: int = 1 << 19) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    a = total = 0
    for b, t in enumerate(texts):
        n = len(t or "")
        if b > a and total + n > most:
            yield slice(a, b)
            a, total = b, 0
        total += n
    if a < len(texts):
        yield slice(a, len(texts))
