"""Suffix arrays by the difference-cover algorithm, vectorised.

Suffixes that begin at positions 1 and 2 modulo 3 are sorted by their first three letters and named; if names repeat, the
string of names is sorted recursively. The remaining suffixes follow from one letter and the rank of the next suffix, and
are merged with the sorted suffixes of either residue by one letter and a rank, or two letters and a rank.
"""

from __future__ import annotations

import numpy as np


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the first key, then the second ... Non-negative keys that fit into 63 bits together are packed."""
    width = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(width) <= 63:
        packed = keys[0].astype(np.int64)
        for k, w in zip(keys[1:], width[1:], strict=True):
            packed = (packed << w) | k
        return np.argsort(packed, kind="stable")
    return np.lexsort(keys[::-1])


def _before(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each row of the sorted keys a the number of rows of the sorted keys b that come before it."""
    width = [int(max(x.max(initial=0), y.max(initial=0))).bit_length() for x, y in zip(a, b, strict=True)]
    if sum(width) <= 63:
        x, y = a[0].astype(np.int64), b[0].astype(np.int64)
        for p, q, w in zip(a[1:], b[1:], width[1:], strict=True):
            x, y = (x << w) | p, (y << w) | q
        return np.searchsorted(y, x)
    order = np.lexsort([np.concatenate([p, q]) for p, q in zip(a, b, strict=True)][::-1])
    own = order < len(a[0])
    out = np.empty(len(a[0]), np.int64)
    out[order[own]] = np.cumsum(~own)[own]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of an array of non-negative integers in lexicographic order; a prefix comes first."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = text.astype(np.int64) + 1
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    first, second, third = t[sample], t[sample + 1], t[sample + 2]
    order = _order(first, second, third)
    a, b, c = first[order], second[order], third[order]
    names = np.cumsum(np.r_[0, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    if names[-1] + 1 < len(sample):
        name = np.empty(len(sample), np.int64)
        name[order] = names
        order = suffix_array(name)
    ranked = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)
    ranked = ranked[ranked < n]
    zeros = np.arange(0, n, 3)
    rest = zeros[_order(t[zeros], rank[zeros + 1])]
    one, two = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    low = _before((t[rest], rank[rest + 1]), (t[one], rank[one + 1])) + _before((t[rest], t[rest + 1], rank[rest + 2]), (t[two], t[two + 1], rank[two + 2]))
    out = np.empty(n, np.int64)
    at = low + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = ranked
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each neighbour pair of `starts` (sorted suffixes with `length` letters at least): whether the first `length` are equal."""
    same = np.ones(max(len(starts) - 1, 0), bool)
    alive = np.arange(len(same))
    for k in range(length):
        ok = text[starts[alive] + k] == text[starts[alive + 1] + k]
        same[alive[~ok]] = False
        alive = alive[ok]
    return same
