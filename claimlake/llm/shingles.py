"""Word shingles of texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers = {_BASE: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    held = _powers[base]
    if len(held) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text.

    A-Z count as a-z; words are runs without blank, tab, line feed, vertical
    tab, form feed and carriage return.  A text of one to four words has one
    shingle, one without words none.
    """
    coded = [t.encode("utf-8") for t in texts]
    data = np.frombuffer((b" ".join(coded) + b" ").translate(_LOWER), dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64) * _PLACES[0])
    grams = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        grams += words[k:k + len(grams)] * _PLACES[k]
    grams = mix(grams)
    limits = np.cumsum([0] + [len(c) + 1 for c in coded])
    at = np.searchsorted(starts, limits)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(grams[a:b - WORDS + 1]))
        elif b > a:
            few = (words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(few + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(hashes: np.ndarray) -> bytes:
    """12 bytes that stand for a set of shingles."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=12).digest()
