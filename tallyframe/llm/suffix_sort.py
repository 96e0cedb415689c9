"""Suffix sorting by the difference cover {1, 2} modulo 3, vectorised with numpy.

Sampled suffixes are sorted by triples and named; while names repeat, the
string of names is sorted the same way; the remaining suffixes are sorted by
one symbol and the rank behind it, and merged in. Comparisons need only be
right for `depth` symbols, so naming stops once names tell that many apart.
"""

from __future__ import annotations

import numpy as np

#: Names must fit three to a 63-bit key.
MOST = (1 << 21) - 8


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `symbols` (0 <= value < MOST) in the order of their suffixes.
    Suffixes that agree on `depth` symbols may stand in any order among themselves."""
    n = len(symbols)
    if n > MOST:
        raise ValueError(f"at most {MOST} symbols at once")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    return _order(symbols.astype(np.int64) + 1, depth)


_BITS = 21
_MASK = (1 << _BITS) - 1


def _order(s: np.ndarray, depth: float) -> np.ndarray:
    n = len(s)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    # one sampled position past the end keeps the two halves of the names apart
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    rank, by_rank = _name(t, sample, depth)
    of = np.zeros(n + 3, np.int64)
    of[sample] = rank + 1
    sample = sample[by_rank]
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    # a value sort of (key, number) is much faster than sorting numbers by key
    zero = zero[np.sort((t[zero] << 2 * _BITS) | (of[zero + 1] << _BITS) | np.arange(len(zero))) & _MASK]
    # how many sampled suffixes of either kind come before each remaining one;
    # ties beyond `depth` may be in any order, so the counts are kept from going back
    pair = (t << 31)[:-1] | of[1:]
    triple = (t[:-2] << 42) | (t[1:-1] << 21) | of[2:]
    kind = sample % 3
    before = np.arange(len(zero))
    for those, code in ((sample[kind == 1], pair), (sample[kind == 2], triple)):
        before = before + np.maximum.accumulate(np.searchsorted(code[those], code[zero]))
    order = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[before] = True
    order[before] = zero
    order[~taken] = sample
    return order


def _name(t: np.ndarray, sample: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the sampled suffixes, in the order of `sample` (first those at 1, then at 2 modulo
    3), and the numbers of the suffixes by rank."""
    m = len(sample)
    number = np.arange(m)
    a, b, c = t[sample], t[sample + 1], t[sample + 2]
    if t.max() < 1 << 14:
        found = np.sort((a << 28 + _BITS) | (b << 14 + _BITS) | (c << _BITS) | number)
    else:
        found = np.sort((a << 2 * _BITS) | (b << _BITS) | number)
        pairs = np.empty(m, np.int64)
        pairs[found & _MASK] = np.concatenate([[0], np.cumsum(np.diff(found >> _BITS) != 0)])
        found = np.sort((pairs << 2 * _BITS) | (c << _BITS) | number)
    order = found & _MASK
    new = np.concatenate([[False], np.diff(found >> _BITS) != 0])
    names = np.empty(m, np.int64)
    names[order] = np.cumsum(new)
    if new[1:].all() or depth <= 3:
        return names, order
    if m < 3:
        order = np.array(sorted(range(m), key=lambda i: names[i:].tolist()), np.int64)
    else:
        order = _order(names + 1, depth / 3 + 1)
    ranks = np.empty(m, np.int64)
    ranks[order] = number
    return ranks, order
