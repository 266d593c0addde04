"""Sets of word shingles as sorted 64-bit hashes, made with array operations over a text's bytes.

Words are maximal runs of bytes outside 0x20 and 0x09 to 0x0D after A-Z are lower-cased. A shingle is a
sequence of ``K`` words; a text with fewer words is one shingle, one without words has none. Words and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np

K = 5
MISS = 1e-13
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(0, 1 << 64, 256, np.uint64)
_ORDER = _rng.integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(0, 1 << 64, K + 1, np.uint64)
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            out[1:] = np.uint64(base)
            _powers[i] = np.multiply.accumulate(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[data], out=inside[1:-1].view(bool))
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    if len(words) < K:
        return mix((words * _ORDER[: len(words)]).sum(keepdims=True) + _SHORT[len(words)])
    n = len(words) - K + 1
    total = words[:n] * _ORDER[0]
    for j in range(1, K):
        total += words[j : j + n] * _ORDER[j]
    return np.unique(mix(total))


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class BandKeys:
    """Keys of bands of MinHash values; ``bands`` is set so that a pair at the threshold has no common
    key with a probability below MISS."""

    def __init__(self, similarity: float, rows: int = 3):
        self.rows, self.bands = rows, int(np.ceil(np.log(MISS) / np.log1p(-(similarity**rows))))
        rng = np.random.Generator(np.random.PCG64(7))
        self.seeds = rng.integers(0, 1 << 64, self.bands * rows, np.uint64)
        self.names = rng.integers(0, 1 << 64, self.bands, np.uint64)
        self.weights = rng.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.seeds), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 1024):
            x = (hashes[None, at : at + 1024] ^ self.seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(least, x.min(axis=1), out=least)
        bands = (least.reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype=np.uint64)
        return mix(bands + self.names).view(np.int64)


def bitmap_width(n: int) -> int:
    """Four to eight bits a shingle, a power of two."""
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(hashes: np.ndarray) -> bytes:
    out = np.zeros(bitmap_width(len(hashes)), np.uint8)
    out[(hashes & np.uint64(len(out) - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def linked(a: int, b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)
