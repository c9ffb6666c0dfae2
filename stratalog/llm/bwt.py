"""Repeated strings of a given length from a Burrows-Wheeler transform, with numpy."""

from __future__ import annotations

import numpy as np

_BITS, _FIRST = 9, 4  # symbols have nine bits; four make the first sort key


def _sorted(key: np.ndarray) -> np.ndarray:
    """Positions in the order of non-negative keys; sorting key and position packed in one integer is faster than argsort."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) >> (63 - bits):
        return np.argsort(key)
    packed = key << bits | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1)


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first ``length`` symbols at least (symbols below 512; past the end counts as smallest)."""
    n = len(symbols)
    padded = np.zeros(n + _FIRST, np.int64)
    padded[:n] = symbols
    key, done = np.zeros(n, np.int64), _FIRST
    for j in range(_FIRST):
        key = (key << _BITS) | padded[j : n + j]
    while True:
        order = _sorted(key)
        new = np.empty(n, bool)
        new[:1], new[1:] = True, key[order[1:]] != key[order[:-1]]
        if done >= length or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        after = np.zeros(n, np.int64)
        after[: max(n - done, 0)] = rank[done:]
        key, done = rank * (n + 1) + after, 2 * done


def boundaries(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edge): edge[i] says that row i shares fewer than ``length`` symbols with row i - 1, for rows without a 0 among these symbols.

    Breadth-first backward extension: level l holds intervals of rows that start with one string of l symbols. Extending
    each by every symbol before its rows gives the intervals of level l + 1; where one ends, the common prefix with the
    next row is l, if no shorter string ended there before. Strings are dropped where an end was known. So common
    prefixes come out by increasing value, and the expansion stops before ``length``. Symbol 0 separates and is only the
    last of a string."""
    n = len(symbols)
    if _BITS + 2 * n.bit_length() > 63:
        raise ValueError("too many symbols for one transform")  # owner, symbol and row share one integer
    order = suffix_order(symbols, length)
    before = np.where(order > 0, symbols[order - 1], 0).astype(np.int16)
    last_first = np.empty(n, np.int64)
    last_first[np.argsort(before, kind="stable")] = np.arange(n)
    edge, bits = np.zeros(n + 1, bool), n.bit_length()
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(length):
        size = high - low
        if not len(size):
            break
        owner = np.repeat(np.arange(len(size)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        symbol = before[rows].astype(np.int64)
        packed = (owner << _BITS | symbol) << bits | rows
        if level:
            packed = packed[symbol != 0]
        packed.sort()
        key, rows = packed >> bits, packed & ((1 << bits) - 1)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(key)]]) - 1 if len(first) else first
        low, high = last_first[rows[first]], last_first[rows[last]] + 1
        fresh = ~edge[high]
        low, high = low[fresh], high[fresh]
        # several strings may end at one row; the widest goes on for all
        high, at = np.unique(high[np.argsort(low, kind="stable")], return_index=True)
        low = np.sort(low, kind="stable")[at]
        edge[high] = True
    edge[0] = True
    return order, edge[:n]


def repeated(symbols: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of valid positions whose ``length`` symbols also start at another valid position, sorted by class."""
    order, edge = boundaries(symbols, length)
    kind = np.cumsum(edge)
    keep = valid[order]
    order, kind = order[keep], kind[keep]
    many = np.bincount(kind)[kind] > 1 if len(kind) else np.zeros(0, bool)
    return order[many], kind[many]
