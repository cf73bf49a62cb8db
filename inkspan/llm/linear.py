"""A sparse logistic model on hashed features, trained on the driver over a bounded set of examples."""

from __future__ import annotations

import math
import zlib

import numpy as np

BITS = 16
#: Examples a step, and the parts of a cross-validation.
BATCH, FOLDS = 64, 3


def slot(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def vector(features: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([slot(k) for k in features], dtype=np.int32), np.array(list(features.values()), dtype=np.float32)


class Examples:
    """Feature vectors one after the other, so that a batch of them is read at once."""

    def __init__(self, xs: list[tuple[np.ndarray, np.ndarray]]):
        self.start = np.concatenate([[0], np.cumsum([len(x[0]) for x in xs])]).astype(np.int64)
        self.index = np.concatenate([x[0] for x in xs]) if xs else np.zeros(0, np.int32)
        self.value = np.concatenate([x[1] for x in xs]) if xs else np.zeros(0, np.float32)

    def rows(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots, values, place in ``order``) of some examples."""
        n = self.start[order + 1] - self.start[order]
        at = np.repeat(self.start[order] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.index[at], self.value[at], np.repeat(np.arange(len(order)), n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    def __init__(self):
        self.w = np.zeros(1 << BITS, dtype=np.float32)
        self.b = 0.0
        self.threshold, self.slope = 0.0, 1.0

    def certainty(self, x: tuple[np.ndarray, np.ndarray]) -> float:
        """Log odds beyond the threshold; above 0 for a finding."""
        return self.slope * (self.score(x) - self.threshold)

    def score(self, x: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.w[x[0]] @ x[1] + self.b)

    def scores(self, xs: Examples, order: np.ndarray) -> np.ndarray:
        slots, values, row = xs.rows(order)
        return np.bincount(row, self.w[slots] * values, len(order)) + self.b

    def fit(self, xs: Examples, ys: np.ndarray, order: np.ndarray, epochs: int = 6, rate: float = 0.3, l2: float = 1e-5, seed: int = 7) -> "Logistic":
        """Adaptive gradient steps over batches of the examples in ``order``."""
        g, gb = np.full(1 << BITS, 1e-2), 1e-2
        w = np.zeros(1 << BITS)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            shuffled = rng.permutation(order)
            for k in range(0, len(shuffled), BATCH):
                part = shuffled[k : k + BATCH]
                slots, values, row = xs.rows(part)
                d = sigmoid(np.bincount(row, w[slots] * values, len(part)) + self.b) - ys[part]
                step = np.bincount(slots, d[row] * values, 1 << BITS)
                hit = np.flatnonzero(step)
                step = step[hit] + l2 * w[hit]
                g[hit] += step * step
                w[hit] -= rate * step / np.sqrt(g[hit])
                gb += float(d.sum()) ** 2
                self.b -= rate * float(d.sum()) / math.sqrt(gb)
        self.w = w.astype(np.float32)
        return self


def held_out(xs: Examples, ys: np.ndarray, groups: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """The score of each example by a model that saw none of its group."""
    out = np.zeros(len(ys))
    for k in range(folds):
        mine = groups % folds == k
        if mine.any() and (~mine).any():
            out[mine] = Logistic().fit(xs, ys, np.flatnonzero(~mine)).scores(xs, np.flatnonzero(mine))
    return out


def calibrated(scores: np.ndarray, ys: np.ndarray, sure: float = 0.5) -> tuple[float, float]:
    """The score from which an example is positive with probability ``sure``, and how fast the log odds rise with the score.

    A logistic curve is laid through all the held-out scores, so no single example moves it far.
    """
    rate = ys.mean()
    if not 0 < rate < 1:
        return (math.inf if rate == 0 else -math.inf), 1.0
    spread = max(float(scores.std()), 1e-9)
    z, soft = scores / spread, np.where(ys, (ys.sum() + 1) / (ys.sum() + 2), 1 / ((~ys).sum() + 2))
    def loss(a: float, b: float) -> float:
        y = a * z + b
        return float((np.logaddexp(0, y) - soft * y).sum()) + 5e-4 * (a * a + b * b)

    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method, with shorter steps where a whole one leads up
        p = sigmoid(a * z + b)
        r, q = p - soft, np.maximum(p * (1 - p), 1e-12)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(r * z).sum() + 1e-3 * a, r.sum() + 1e-3 * b])
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * da, b - size * db) > now:
            size /= 2
        a, b = a - size * da, b - size * db
        if abs(da) + abs(db) < 1e-7:
            break
    if a <= 1e-6:
        return math.inf, 1.0
    return float((math.log(sure / (1 - sure)) - b) / a * spread), float(a / spread)
