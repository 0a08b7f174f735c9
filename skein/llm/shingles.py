"""Word shingles of whole texts as sorted sets of 64-bit hashes, and signatures of parts of such sets, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits in the manner of splitmix."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The bytes that separate words. A-Z count as a-z.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BYTE = mix(np.arange(256, dtype=_U) + _U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_BASE, _STEP = _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _BASE, _U)]))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = _IS_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(x) + 1 for x in texts])
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    lengths = stops - starts
    letters = _BYTE[data[inside]]
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(offsets, lengths)
    powers = _powers(1 << int(lengths.max()).bit_length())
    sums = np.add.reduceat(letters * powers[place], offsets)
    counts = np.diff(np.searchsorted(starts, ends, side="left"), prepend=0)
    return mix(sums + lengths.astype(_U)), counts


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of `n` words of each text: its whole sequence if it has fewer, none if it has no words."""
    words, counts = word_hashes([x.encode() for x in texts])
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - n + 1), _U)
    for k in range(n):
        rolled = rolled * _STEP + words[k : len(words) - n + 1 + k] if len(rolled) else rolled
    rolled = mix(rolled)
    out = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(rolled[end - count : end - n + 1]))
        elif count:
            whole = _U(count)
            with np.errstate(over="ignore"):
                for x in words[end - count : end]:
                    whole = whole * _STEP + x
            out.append(mix(np.array([whole ^ _U(0xA5A5)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


@dataclass(frozen=True)
class SizeClass:
    """Sets of `low` up to `high` elements, `high` not included. Two of at most `high` - 1 that link differ in `differ` elements at most."""

    number: int
    low: int
    high: int
    differ: int
    parts: int
    spare: int


class Partition:
    """Signatures such that two sets which link have some in common, if they aren't equal.

    Hash space is cut into parts. If sets differ in d elements at most, of d + 1 + s parts s + 1 are equal in both. Each
    part that isn't empty gives a signature. A set with more than s empty parts gives signatures of those as well, since
    all equal parts might be empty. So two sets of a and b elements that link share, in one class, as many signatures as the
    larger number of parts that aren't empty exceeds differ(a + b), and 1 at least. Sets fall into classes by size, because d depends on it; a set that may link with
    larger ones gives the signatures of their classes, too.
    """

    def __init__(self, percent: int, ratio: float = 1.3, equal: int = 4):
        self.percent, self.ratio, self.equal, self.classes = percent, ratio, equal, []

    def of(self, size: int) -> SizeClass:
        while not self.classes or self.classes[-1].high <= size:
            low = self.classes[-1].high if self.classes else 1
            high = max(low + 1, int(low * self.ratio))
            differ = self.differ(2 * (high - 1))
            spare = self.equal - 1
            for _ in range(20):
                parts = differ + 1 + spare
                wanted = self.equal - 1 + ceil(2 * parts * (1 - 1 / parts) ** low)
                if wanted <= spare:
                    break
                spare = wanted
            self.classes.append(SizeClass(len(self.classes), low, high, differ, differ + 1 + spare, spare))
        at = len(self.classes) - 1
        while self.classes[at].low > size:
            at -= 1
        return self.classes[at]

    def differ(self, total: int) -> int:
        """In how many elements two sets with `total` elements together may differ if they link."""
        return total * (100 - self.percent) // (100 + self.percent)

    def signatures(self, sets: list[np.ndarray]) -> list[list[tuple[int, int, np.ndarray]]]:
        """(class, parts that aren't empty, signatures) of each set in each class that it takes part in."""
        jobs: list[tuple[int, SizeClass]] = []
        for k, x in enumerate(sets):
            if len(x):
                own, last = self.of(len(x)).number, self.of(len(x) * 100 // self.percent).number
                jobs += [(k, self.classes[c]) for c in range(own, last + 1) if self.classes[c].differ]
        found: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in sets]
        if jobs:
            tokens = np.concatenate([sets[k] for k, _ in jobs])
            lengths = np.array([len(sets[k]) for k, _ in jobs])
            owner = np.repeat(np.arange(len(jobs)), lengths)
            parts = np.array([c.parts for _, c in jobs], _U)
            numbers = np.array([c.number for _, c in jobs], _U)
            part = ((tokens >> _U(32)) * parts[owner]) >> _U(32)
            first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
            sums = np.add.reduceat(mix(tokens ^ _U(0x5851F42D4C957F2D)), first)
            job = owner[first]
            sig = mix(sums ^ mix(numbers[job] << _U(40) | part[first]))
            filled = np.bincount(job, minlength=len(jobs))
            for j, rows in enumerate(np.split(sig, np.cumsum(filled)[:-1])):
                k, c = jobs[j]
                empties = int(c.parts - filled[j])
                if empties > c.spare:
                    used = part[first][job == j]
                    empty = np.setdiff1d(np.arange(c.parts, dtype=_U), used)
                    rows = np.concatenate([rows, mix(mix(_U(c.number) << _U(40) | empty) ^ _U(0x3C6EF372FE94F82B))])
                found[k].append((c.number, int(filled[j]), rows))
        return found
