"""Word shingles as 64-bit fingerprints, and SetSketch registers over them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

SHINGLE = 5
REGISTERS = 128
BASE = 1.005
RATE = 20.0
TOP = 65534  # registers are unsigned 16-bit numbers: 0 .. TOP + 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_ROWS = 512  # shingles sketched at a time: the block stays in cache

_draw = np.random.Generator(np.random.PCG64(20240501))
_SEEDS = _draw.integers(0, 2**63, REGISTERS, np.uint64)
_FACTORS = _draw.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, in UTF-8.

    ``bytes.lower`` and ``bytes.split`` work on exactly these ASCII characters.
    """
    return text.encode("utf-8", "replace").lower().split()


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct fingerprints of the word shingles of a whole text.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64) * _ODD
    for j in range(width):
        out = (out ^ found[j : n - width + 1 + j]) * _MIX
        out ^= out >> _SHIFT
    return np.unique(out * _ODD)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: for each hash function the truncated logarithm of its least value.

    The least of exponentially spaced values is taken over the set, so sketches of two
    sets merge by a maximum per register, and two sets agree in a register with a
    probability that grows with their similarity.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _ROWS):
        block = shingles[at : at + _ROWS, None] ^ _SEEDS
        block *= _FACTORS
        np.minimum(least, block.min(0), out=least)
    spaced = -np.log1p(-np.minimum((least + 1.0) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1.0 - np.log(spaced) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 101) -> np.ndarray:
    """Jaccard similarity of many pairs by joint likelihood.

    ``a`` and ``b`` hold one row of registers per pair, ``n_a`` and ``n_b`` the set
    sizes. The registers of a pair are counted as greater, smaller and equal; the
    similarity is the one on a grid that makes these counts likeliest.
    """
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    limit = np.minimum(u / v, v / u)
    j = np.linspace(0.0, 1.0, steps)[None, :] * limit

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / math.log(BASE)

    p_up, p_down = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    log = up * np.log(np.maximum(p_up, tiny)) + down * np.log(np.maximum(p_down, tiny))
    log = log + same * np.log(np.maximum(1.0 - p_up - p_down, tiny))
    return np.take_along_axis(j, log.argmax(1)[:, None], 1)[:, 0]
