"""Words and word shingles of whole texts as numpy arrays of 64-bit hashes.

A word is a longest run of characters other than space and the five ASCII controls 9 to 13; A to Z are
lower-cased. A text with at least ``size`` words has its distinct ``size``-word shingles, a shorter one its
whole word sequence as the only shingle, and a text without words has none.
"""

from __future__ import annotations

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(salt))


BYTE_VALUES = seeds(256, 11)
PLACE = seeds(64, 12) | U(1)
_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, SEGMENT // 16), b, dtype=U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _segments(data: bytes):
    """Pieces of about a megabyte, cut at spaces only."""
    at = 0
    while len(data) - at > SEGMENT:
        end = at + SEGMENT
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(data: bytes) -> np.ndarray:
    """The words of a UTF-8 text, in order."""
    found = []
    for piece in _segments(data):
        if not piece:
            continue
        b = np.frombuffer(piece.translate(LOWER), dtype=np.uint8)
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = ~SPACE[b]
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        power, inverse = _power_tables(len(b))
        total = np.zeros(len(b) + 1, dtype=U)
        np.cumsum(BYTE_VALUES[b] * power[: len(b)], out=total[1:])
        found.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U)))
    return np.concatenate(found) if found else np.zeros(0, dtype=U)


def shingle_hashes(data: bytes, size: int = 5) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, sorted."""
    words = word_hashes(data)
    if not len(words):
        return words
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, dtype=U)
    for k in range(width):
        out += words[k : len(words) - width + 1 + k] * PLACE[k]
    out = np.sort(mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether the shares of two sorted sets' union that they have in common reaches ``percent``; empty sets never do."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (small + large - common)
