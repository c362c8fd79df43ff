"""Vectorised hashing of the words of many texts at once.

A word is a maximal run of ASCII letters and digits and non-ASCII characters other than
general punctuation and spaces, in lower case. Every word of every text is hashed; nothing
is cut. Work is done on chunks of bytes, so memory stays bounded however long a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_ODD = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u1680\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]")
#: The words of a text as spans, by the same rule as the hashes.
WORD = re.compile("[0-9A-Za-z\u00aa\u00b5\u00ba\u00c0-\u167f\u1681-\u1fff\u2070-\u2fff\u3040-\uff00\uff10-\uff19\uff21-\U0010ffff]+")

_MIX1, _MIX2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWER = np.cumprod(np.full(64, 0x5851F42D4C957F2D, np.uint64))
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = np.cumprod(np.full(max(n, 2 * len(_POWER)), 0x5851F42D4C957F2D, np.uint64))
    return _POWER


def normal(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = _ODD.sub(" ", text)
    return text.encode("utf-8", "replace")


def _hash_bytes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of buf, and where each starts."""
    raw = np.frombuffer(buf, np.uint8)
    at = np.flatnonzero(_IS_WORD[raw])
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    sums = np.add.reduceat(_BYTE[raw[at]] * _power(int(length.max()))[place], first)
    return mix(sums + length.astype(np.uint64)), at[first]


def hash_words(texts: list[str]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """For successive runs of texts: their indexes, all their word hashes, and the offset of each text's words (one more than texts)."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (j == i or size < CHUNK_BYTES):
            parts.append(normal(texts[j] or ""))
            size += len(parts[-1]) + 1
            j += 1
        ends = np.cumsum([len(p) + 1 for p in parts])
        if len(parts) == 1 and size > 2 * CHUNK_BYTES:
            hashes = _hash_long(parts[0])
            yield range(i, j), hashes, np.array([0, len(hashes)])
        else:
            hashes, at = _hash_bytes(b"\n".join(parts))
            yield range(i, j), hashes, np.concatenate(([0], np.searchsorted(at, ends)))
        i = j


def _hash_long(buf: bytes) -> np.ndarray:
    """One very long text, cut between words."""
    found, start = [], 0
    while start < len(buf):
        end = min(start + CHUNK_BYTES, len(buf))
        while end < len(buf) and _IS_WORD[buf[end]]:
            end += 1
        found.append(_hash_bytes(buf[start:end])[0])
        start = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def hash_terms(terms: list[str]) -> np.ndarray:
    """The hash of each term, which must be one word."""
    if not terms:
        return np.empty(0, np.uint64)
    hashes, at = _hash_bytes(b"\n".join(normal(t) for t in terms))
    if len(hashes) != len(terms):
        raise ValueError("each term must be one word")
    return hashes


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, in order; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
