"""SetSketch registers of word shingles, with numpy only.

A register holds floor(1 - log_b(x)) of the smallest of exponentially
distributed values x, one per element, cut to 0..q+1 (b = 1.001, 16 bits).
Registers of a union are the maxima of registers, so sketches merge.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_U = np.uint64


@dataclass(frozen=True)
class SketchRules:
    """words: per shingle. registers: in a sketch. rows: registers per band.
    rate, base, top: of the exponential values and of their logarithm."""

    words: int = 5
    registers: int = 128
    rows: int = 4
    rate: float = 20.0
    base: float = 1.001
    top: int = 65534
    seed: int = 20240


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64. Long tables, for long texts, aren't kept."""
    size = 1 << max(16, (n - 1).bit_length())
    return _kept_powers(size) if size <= 1 << 21 else _new_powers(n)


@lru_cache(maxsize=2)
def _kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(n)


def _new_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    odd = 0x9E3779B97F4A7C15
    found = []
    for p in (odd, pow(odd, -1, 1 << 64)):
        table = np.full(n, p, _U)
        table[0] = 1
        found.append(np.multiply.accumulate(table, out=table))
    return found[0], found[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word; words are split by ASCII white space. A polynomial: fit for features, not for
    telling texts apart, since different words may be made to have one hash."""
    a = np.frombuffer(data, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space, [1]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * up[: len(a)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(_U)), begin, end


class _Numbered(dict):
    """Numbers of words in the order in which they are met; their digests wait in `new`."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(hashlib.blake2b(word, digest_size=16).digest())
        self[word] = len(self)
        return len(self) - 1


class WordDigests:
    """128-bit digests of words; of the words met before, `most` and those of one call are remembered."""

    def __init__(self, most: int = 100_000):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.known, self.size = _Numbered(), np.zeros((1 << 12, 2), _U), 0

    def of(self, words: list[bytes]) -> np.ndarray:
        """(n, 2) halves of the digests."""
        if self.size > self.most:
            self._forget()
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        new = self.numbers.new
        if new:
            if self.size + len(new) > len(self.known):
                self.known = np.concatenate([self.known[: self.size], np.zeros((self.size + 2 * len(new), 2), _U)])
            self.known[self.size : self.size + len(new)] = np.frombuffer(b"".join(new), "<u8").reshape(-1, 2)
            self.size += len(new)
            new.clear()
        return self.known[at]


def _pieces(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """data cut at white space into pieces of about `limit` bytes."""
    start = 0
    while len(data) - start > limit and (space := re.compile(rb"[ \t-\r]").search(data, start + limit)):
        yield data[start : space.start()]
        start = space.start()
    yield data[start:]


def shingle_sets(texts: list[bytes], words: int, digests: WordDigests) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, A-Z lower-cased, as two independent 64-bit hashes each, sorted by the first;
    a text of fewer words is one shingle, one without words has none. Words count by 128-bit digests, so that different
    shingles are told apart but for chances of 2**-128."""
    hashed = [[digests.of(piece.split()) for piece in _pieces(t.lower())] for t in texts]
    first = np.concatenate([[0], np.cumsum(np.fromiter((sum(map(len, h)) for h in hashed), np.int64, len(texts)))])
    hashed = np.concatenate([*(p for h in hashed for p in h), np.zeros((0, 2), _U)])
    n = len(hashed) - words + 1
    odd = mix(np.arange(1, 2 * words + 3, dtype=_U) * _U(0xD1B54A32D192ED03)).reshape(-1, 2) | _U(1)
    whole = np.zeros((max(n, 0), 2), _U)
    for i in range(words if n > 0 else 0):
        whole += hashed[i : i + n] * odd[i]
    whole = mix(whole)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(_distinct(whole[a : b - words + 1]))
        elif b > a:
            one = mix((hashed[a:b] * odd[: b - a]).sum(axis=0) + odd[-1] * _U(b - a))
            sets.append((one[:1].copy(), one[1:].copy()))
        else:
            sets.append((np.zeros(0, _U), np.zeros(0, _U)))
    return sets


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of two hashes, sorted by the first."""
    order = np.argsort(pairs[:, 0])
    one, two = pairs[order, 0], pairs[order, 1]
    same, equal = one[1:] == one[:-1], two[1:] == two[:-1]
    if (same & ~equal).any():
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        one, two = pairs[order, 0], pairs[order, 1]
        same, equal = one[1:] == one[:-1], two[1:] == two[:-1]
    new = np.concatenate([[True], ~(same & equal)])
    return one[new], two[new]


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum())


def set_digest(shingles: tuple[np.ndarray, np.ndarray]) -> bytes:
    """128 bits of a whole set."""
    return hashlib.blake2b(shingles[0].tobytes() + shingles[1].tobytes(), digest_size=16).digest()


@lru_cache(maxsize=4)
def _multipliers(rules: SketchRules) -> np.ndarray:
    return mix(np.arange(1, rules.registers + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(rules.seed)) | _U(1)


def registers(elements: np.ndarray, rules: SketchRules) -> np.ndarray:
    """The sketch of one set, as uint16."""
    odd = _multipliers(rules)
    least = np.full(rules.registers, np.iinfo(_U).max, _U)
    block = np.empty((min(len(elements), 512), rules.registers), _U)
    for i in range(0, len(elements), 512):
        part = elements[i : i + 512]
        hashed = np.multiply(part[:, None], odd[None, :], out=block[: len(part)])
        np.minimum(least, hashed.min(axis=0), out=least)
    # the smallest uniform value gives the smallest exponential one
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64) / rules.rate
    level = np.floor(1.0 - np.log(smallest) / np.log(rules.base))
    return np.clip(level, 0, rules.top + 1).astype(np.uint16)


def band_keys(sketches: np.ndarray, rules: SketchRules) -> np.ndarray:
    """(sketch, band) keys as int64; sketches: (n, registers) of uint16."""
    n, bands = len(sketches), rules.registers // rules.rows
    parts = sketches[:, : bands * rules.rows].reshape(n, bands, rules.rows).astype(_U)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (n, bands)).copy()
    for i in range(rules.rows):
        keys = mix(keys ^ (parts[:, :, i] + _U(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, rules: SketchRules) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set
    sizes, from how many registers are larger on either side or equal; on a grid of 1/200."""
    more, fewer = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - more - fewer
    u = (size_a / (size_a + size_b))[:, None]
    v = 1.0 - u
    grid = np.linspace(0.0, 1.0, 201)[None, :] * np.minimum(u / v, v / u)
    step = (rules.base - 1.0) / rules.base

    def larger(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * step) / np.log(rules.base)

    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = larger(u - v * grid), larger(v - u * grid)
        likely = sum(np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0) for n, x in ((more, p), (fewer, q), (equal, 1.0 - p - q)))
    return grid[np.arange(len(grid)), likely.argmax(axis=1)]
