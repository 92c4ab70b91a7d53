"""Hashes of words and of five-word shingles for many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE = 0xD6E8FEB86659FD93
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A value for each byte, from a fixed seed.
_BYTE = np.random.Generator(np.random.PCG64(12345)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SLOT = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA5A3564E27F8865B], np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, 1 << 20)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(hashes, bounds, data, starts, ends): the words of text i are hashes[bounds[i]:bounds[i+1]].

    Words are runs without space or \\t\\n\\v\\f\\r; ``data[starts[j]:ends[j]]`` is the j-th word.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join([*encoded, b""])
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_WHITE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])]).astype(np.int64)
    return hashes, np.searchsorted(starts, offsets), data, starts, ends


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all runs of five words; a text of one to four words is one shingle."""
    hashes, bounds, *_ = words(texts)
    count = np.diff(bounds)
    full = np.maximum(count - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(texts)), full)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full) + np.arange(full.sum())
    out = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        out += hashes[first + k] * _SLOT[k]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    rest = np.array([int(sum(int(h) * int(_SLOT[k]) for k, h in enumerate(hashes[bounds[i] : bounds[i + 1]]))) & ((1 << 64) - 1) for i in short], np.uint64)
    return mix(np.concatenate([out, rest])), np.concatenate([owner, short])


def multiset(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash), sorted, with how often each occurs."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))
