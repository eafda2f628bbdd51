"""Words of texts as 64-bit hashes, and shingles of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """The runs of [^\\x20\\x09-\\x0D] after lower-casing A-Z; bytes split and lower just so."""
    return (text or "").encode("utf-8", "replace").lower().split()


def hashes_of(words: Sequence[bytes]) -> np.ndarray:
    """Hashing a word anew costs less than remembering it."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Values spread over all 64 bits."""
    values = (values ^ (values >> np.uint64(30))) * _MIX2
    values = (values ^ (values >> np.uint64(27))) * _MIX
    return values ^ (values >> np.uint64(31))


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, in order; with fewer words, of the whole sequence;
    without words, none."""
    n = min(size, len(words))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    count = len(words) - n + 1
    total = np.full(count, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        total = total * _MIX + words[i: i + count]
        total ^= total >> np.uint64(32)
    return mixed(total)
