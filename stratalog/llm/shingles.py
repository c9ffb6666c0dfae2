"""64-bit hashes of the word shingles of UTF-8 texts, computed for whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; a piece ends at white space, so only one longer word makes a longer piece.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Fixed value: what separates words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(max(n, PIECE + 4096), base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each white-space word of the bytes."""
    whole, starts, hashes, at = np.frombuffer(data, np.uint8), [], [], 0
    space = _SPACE[whole]
    while at < len(whole):
        end = min(at + PIECE, len(whole))
        while end < len(whole) and not space[end]:
            rest = np.flatnonzero(space[end : end + PIECE])
            end = end + int(rest[0]) if len(rest) else min(end + PIECE, len(whole))
        inside = np.concatenate([[False], ~space[at:end], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            up, down = _power(end - at + 1)
            total = np.zeros(end - at + 1, np.uint64)
            np.cumsum((whole[at:end].astype(np.uint64) + np.uint64(1)) * up[: end - at], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased. Fewer words than ``size``: the whole sequence is one; no words: none."""
    data = [(t or "").encode().lower() for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    start, h = word_hashes(b"\n".join(data))
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    last = np.searchsorted(start, ends)
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            rolled = rolled * _STEP + h[j : len(h) - size + 1 + j]
        rolled = mix(rolled)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            x = np.uint64(b - a)
            for j in range(a, b):
                x = mix(np.array([x], np.uint64))[0] ^ h[j]
            yield mix(np.array([x], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
