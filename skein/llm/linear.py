"""Hashed character n-grams in NumPy and a logistic model over them; both classifiers use these."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: n-gram sizes and the base-2 logarithm of the number of buckets.
SIZES, BITS = (3, 4, 5), 20
#: Bytes of text that a worker takes at once; arrays of its n-grams take up to a hundred times as much.
SLICE = 1 << 18


def grams(texts: list[str], sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the text's index and the bucket of every n-gram of lower-cased code points; none spans two texts."""
    lowered = [x.lower() for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in lowered])
    key, size = codes.copy(), 1
    for n in sorted(sizes):
        while size < n:
            if len(key) < 2:
                return
            key = key[:-1] * np.uint32(0x01000193) + codes[size:]
            size += 1
        inside = owner[: len(key)] == owner[size - 1 :]
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(2654435761 + 2 * n)
        mixed ^= mixed >> np.uint32(13)
        yield owner[: len(key)][inside], ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))[inside]


def distinct_hits(texts: list[str], wanted: np.ndarray, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct bucket of each text that is not zero in `wanted`."""
    found = [np.zeros(0, np.int64)]
    for owner, bucket in grams(texts, sizes, bits):
        hit = np.flatnonzero(wanted[bucket])
        found.append(owner[hit].astype(np.int64) << bits | bucket[hit])
    keys = np.unique(np.concatenate(found))
    return keys >> bits, keys & ((1 << bits) - 1)


@dataclass
class Model:
    """A score is the logistic function of `bias` plus the `weights` of a text's distinct buckets."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS

    def scores(self, texts: list[str], more: np.ndarray | float = 0.0) -> np.ndarray:
        owner, bucket = distinct_hits(texts, self.weights, self.sizes, self.bits)
        sums = np.bincount(owner, weights=self.weights[bucket], minlength=len(texts))
        return sigmoid(sums + self.bias + more)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: Entries of a matrix that a step takes at once, which bounds its temporary arrays.
PIECE = 1 << 19


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, target: np.ndarray, width: int, l2: float = 1e-4, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; `target` may be probabilities. Entry k of the matrix is values[k] at (rows[k], columns[k]).

    Entries of 32 bits each do; sums over them are made piece by piece.
    """
    n = max(1, len(target))
    weights, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    share = float(np.clip(target.mean() if len(target) else 0.5, 1e-3, 1 - 1e-3))
    weights[-1] = np.log(share / (1 - share))
    pieces = [slice(k, k + PIECE) for k in range(0, len(rows), PIECE)]
    for t in range(1, steps + 1):
        z, gradient = np.full(len(target), weights[-1]), np.empty(width + 1)
        for p in pieces:
            z += np.bincount(rows[p], weights=values[p] * weights[columns[p]], minlength=len(target))
        slope = (sigmoid(z) - target) / n
        gradient[:-1], gradient[-1] = l2 * weights[:-1], slope.sum()
        for p in pieces:
            gradient[:-1] += np.bincount(columns[p], weights=values[p] * slope[rows[p]], minlength=width)
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        weights -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return weights[:-1], float(weights[-1])
