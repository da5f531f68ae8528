"""Words and shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(count: int, stream: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(stream))


CODES = seeds(256, 1)[LOWER]
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < count:
        size = max(1 << 16, 1 << int(count).bit_length())
        _powers[:] = [
            np.concatenate([[_U(1)], np.multiply.accumulate(np.full(size - 1, base, _U))])
            for base in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers[0][:count], _powers[1][:count]


def word_hashes(text: str, window: int = 1 << 20) -> np.ndarray:
    """One hash a word; words are runs without ASCII white space, A-Z lower-cased. Long texts are
    read in windows that end at white space."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + window)
        while stop < len(data) and not BLANK[data[stop]]:
            stop += 1
        parts.append(_window_hashes(data[at:stop]))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _window_hashes(raw: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate(([1], BLANK[raw], [1])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(raw) + 1)
    total = np.concatenate(([_U(0)], np.cumsum(CODES[raw] * up[:-1])))
    return mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(_U))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``words`` words; a shorter text is one shingle, an empty one none."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    size = min(words, len(w))
    joined = np.zeros(len(w) - size + 1, _U)
    for j in range(size):
        joined = joined * _U(0x2545F4914F6CDD1D) + w[j : len(w) - size + 1 + j]
    return np.unique(mix64(joined + _U(size)))


def signature(shingles: np.ndarray, turns: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """High 32 bits of the smallest value under each permutation in ``turns``."""
    low = np.full(len(turns), ~_U(0))
    for at in range(0, len(shingles), block):
        part = (shingles[None, at : at + block] ^ turns[:, None]) * (turns[:, None] | _U(1))
        part ^= part >> _U(29)
        part *= _U(0xBF58476D1CE4E5B9)
        low = np.minimum(low, part.min(1))
    return (low >> _U(32)).astype(np.uint32)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return b"".join(mix64(shingles ^ _U(k)).sum(dtype=_U).tobytes() for k in (0x1F83D9AB, 0x5BE0CD19))
