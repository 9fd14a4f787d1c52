"""Hashes of words and of shingles, computed for many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n or len(_powers[0]) > max(n, 1 << 22):  # a very long text's tables are not kept
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def normalized(text: str | None) -> bytes:
    """Words (between space and \\x09-\\x0D) in a row with single spaces, A-Z in lower case."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def digest(norm: bytes) -> bytes:
    return hashlib.blake2b(norm, digest_size=16).digest()


def word_hashes(norms: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text."""
    data = np.frombuffer(b" ".join(norms) + b" ", np.uint8)
    counts = np.array([n.count(b" ") + 1 for n in norms])  # an empty text has one empty word, dropped below
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    cuts = np.cumsum(counts)
    return [hashes[c - n : c] if norm else hashes[:0] for norm, c, n in zip(norms, cuts.tolist(), counts.tolist(), strict=True)]


def hashed_texts(norms: list[bytes], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """word_hashes of each text, taken some at a time so that arrays stay small: `most` bytes of texts, or one text."""
    start = size = 0
    for end, norm in enumerate(norms):
        if size and size + len(norm) > most:
            yield from word_hashes(norms[start:end])
            start, size = end, 0
        size += len(norm) + 1
    if start < len(norms):
        yield from word_hashes(norms[start:])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; for fewer words one of them all; for none, none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * U(0xD6E8FEB86659FD93) + words[i : n - k + 1 + i]
    return mix(h)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each span of data."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
