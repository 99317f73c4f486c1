"""Logistic regression on sets of hashed features, with an optional penalty on score changes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Features that are looked at together.
PART = 1 << 18


@dataclass
class Sets:
    """Rows of distinct features: those of row r are `of[at[r]:at[r + 1]]`."""

    at: np.ndarray
    of: np.ndarray

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, feature) of all rows, for about PART features at a time, one row at least: 64-bit copies of all rows at once
        would be several times what the sets take."""
        a, n = 0, len(self.at) - 1
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.at, self.at[a] + PART, "right")) - 1))
            yield np.repeat(np.arange(a, b), np.diff(self.at[a : b + 1])), self.of[self.at[a] : self.at[b]]
            a = b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def select(sets: Sets, target: np.ndarray, buckets: int, least: int, score: float, most: int) -> np.ndarray:
    """The features in at least `least` rows whose share differs between the classes by `score` standard
    errors, the strongest `most` of them."""
    n, ones = np.zeros(buckets), np.zeros(buckets)
    for row, of in sets.parts():
        np.add.at(n, of, 1.0)
        np.add.at(ones, of, target[row])
    n1, n0 = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    p = n / max(len(target), 1)
    z = (ones / n1 - (n - ones) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    z = np.where(n >= least, np.abs(z), 0)
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] >= score])


def fit(sets: Sets, target: np.ndarray, features: np.ndarray, ridge: float = 1e-3, pairs: tuple[Sets, Sets] | None = None, pairing: float = 1.0, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weight of each feature): full-batch Adam on the mean log loss, an L2 penalty, and
    `pairing` times the mean square of the score's change from the first set to the second of each pair."""
    slot = {int(f): i for i, f in enumerate(features)}

    def narrow(s: Sets) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, of in s.parts():
            keep = np.isin(of, features)
            rows.append(row[keep])
            cols.append(np.array([slot[int(f)] for f in of[keep]], np.int64))
        return np.concatenate(rows), np.concatenate(cols)

    rows, cols = narrow(sets)
    k, n = len(features), max(1, len(target))
    if pairs:
        a, b = narrow(pairs[0]), narrow(pairs[1])
        prow, pcol = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        sign = np.concatenate((np.ones(len(a[0])), -np.ones(len(b[0]))))
        m = max(1, len(pairs[0].at) - 1)
    w, bias = np.zeros(k), float(np.log((target.sum() + 1) / ((1 - target).sum() + 1)))
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for turn in range(1, rounds + 1):
        points = np.bincount(rows, weights=w[cols], minlength=n) + bias if k else np.full(n, bias)
        gap = sigmoid(points) - target
        grad = np.bincount(cols, weights=gap[rows], minlength=k) / n + ridge * w
        if pairs and len(prow):
            change = np.bincount(prow, weights=w[pcol] * sign, minlength=m)
            grad += 2 * pairing * np.bincount(pcol, weights=change[prow] * sign, minlength=k) / m
        grad = np.append(grad, gap.mean())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        step = 0.15 * (1 - turn / (rounds + 1)) * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return float(bias), w
