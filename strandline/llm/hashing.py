"""Array hashing of the words of many texts at once.

A word's hash is a sum over its bytes of (random value of the byte) x base^position,
modulo 2^64, taken from prefix sums and shifted to position 0, then mixed.  All words
of a buffer cost a few array operations, whatever their number.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; a buffer is cut at a gap between words.
SLICE = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

# White space between words, and A-Z to a-z (fixed values).
GAPS = (32, *range(9, 14))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(GAPS)] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(
                np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
                for b in (_BASE, _INVERSE)
            )
    return _powers[size]


def _hash_slice(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _IS_WORD[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    power, inverse = _power_tables(len(buffer))
    with np.errstate(over="ignore"):
        sums = np.empty(len(buffer) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[buffer] * power[: len(buffer)], out=sums[1:])
        words = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(words + (ends - starts).astype(np.uint64)), starts


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of every word, in order."""
    if len(text) <= SLICE:
        return _hash_slice(np.frombuffer(text, np.uint8))
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and text[end] not in GAPS:
            end += 1
        h, s = _hash_slice(np.frombuffer(text, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def words_of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where the words of each text begin
    (one entry more than texts)."""
    hashes, starts = hash_words(b"\n".join(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return hashes, np.searchsorted(starts, offsets)
