"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SEGMENT = 1 << 19
_RNG = np.random.default_rng(20240)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _RNG.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int):
    """Powers of the base and of its inverse modulo 2^64, n of them at least."""
    have = _powers.get("n", 0)
    if have < n:
        size = max(n, 2 * have, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def _segments(joined: np.ndarray):
    """Bounds of stretches of about _SEGMENT bytes that end in a space; a longer word is not cut."""
    a = 0
    while a < len(joined):
        b = a + _SEGMENT
        if b < len(joined):
            inside = np.flatnonzero(_SPACE[joined[a:b]])
            while not len(inside) and b < len(joined):
                a_, b = b, b + _SEGMENT
                inside = np.flatnonzero(_SPACE[joined[a_:b]]) + (a_ - a)
            b = a + int(inside[-1]) + 1
        yield a, min(b, len(joined))
        a = b


def word_hashes(texts: list[bytes]):
    """The hash of each word of each text, one after another, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for a, b in _segments(joined):
        part = joined[a:b]
        space = _SPACE[part]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.r_[0, edge]
        start, end = edge[0::2], edge[1::2]
        up, down = powers(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=run[1:])
        hashes.append(mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)))
        counts += np.bincount(np.searchsorted(ends, start + a, "right"), minlength=len(texts))
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of WORDS words; fewer words are one run."""
    words, counts = word_hashes(texts)
    out = []
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        h = np.zeros(n, np.uint64)
        for j in range(WORDS):
            h += words[j : j + n] * _PLACE[j]
        h = mixed(h)
    at = 0
    for c in counts.tolist():
        if c >= WORDS:
            s = np.sort(h[at : at + c - WORDS + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif c:
            out.append(mixed((words[at : at + c] * _PLACE[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
