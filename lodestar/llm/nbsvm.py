"""Naive Bayes support vectors: a linear model over n-gram indicators, in numpy.

An indicator of an n-gram is scaled by the log ratio of its share in the two classes' documents, documents are
scaled to length 1, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become
probabilities by a sigmoid fitted to the margins of a model that hasn't seen the row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Byte n-grams of these lengths, hashed into BUCKETS indicators.
ORDERS, BUCKETS = (1, 2, 3), 1 << 18
#: And n-grams of this length over recurrences: how many words ago a word came last (0: over RECENT, or never).
RECURRENCES, RECENT = 4, 31
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def recurrences(text: str | None) -> np.ndarray:
    last: dict[bytes, int] = {}
    out = []
    for i, w in enumerate((text or "").encode().split()):
        d = i - last.get(w, -RECENT - 1)
        out.append(d if d <= RECENT else 0)
        last[w] = i
    return np.array(out, np.uint64)


class Indicators:
    """The distinct hashed n-grams of a text; the work array is kept between texts."""

    def __init__(self, orders=ORDERS, buckets: int = BUCKETS):
        self.orders, self.shift, self.last = orders, np.uint64(64 - (buckets.bit_length() - 1)), np.zeros(buckets, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64)
        found = []
        for n in self.orders:
            if len(data) < n:
                continue
            gram = np.full(len(data) - n + 1, n, np.uint64)
            for i in range(n):
                gram <<= np.uint64(8)
                gram |= data[i : len(data) - n + 1 + i]
            gram *= _MULTIPLIER
            gram >>= self.shift
            found.append(gram)
        if len(back := recurrences(text)) >= RECURRENCES:
            gram = np.full(len(back) - RECURRENCES + 1, 1 << 40, np.uint64)
            for i in range(RECURRENCES):
                gram += back[i : len(gram) + i] << np.uint64(5 * i)
            gram *= _MULTIPLIER
            gram >>= self.shift
            found.append(gram)
        if not found:
            return np.empty(0, np.int32)
        at = np.concatenate(found).astype(np.int32)
        order = np.arange(len(at), dtype=np.int32)
        self.last[at] = order
        return at[self.last[at] == order]


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    counts = []
    for side in (1, 0):
        c = np.full(buckets, smooth)
        for x in (rows[i] for i in np.flatnonzero(labels == side)):
            c[x] += 1
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights over the scaled indicators and a bias, by dual coordinate descent on the L1 hinge loss."""
    y = np.where(labels == 1, 1.0, -1.0)
    scaled = [ratio[x] / max(np.sqrt((ratio[x] ** 2).sum()), 1e-12) for x in rows]
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    upper = np.where(y > 0, cost, cost * max(1.0, (y > 0).sum() / max(1, (y < 0).sum())))  # the rarer class weighs as much
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            g = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), upper[i])  # |v|^2 + 1 for the bias = 2
            if (d := new - alpha[i]) != 0.0:
                w[x] += d * y[i] * v
                bias += d * y[i]
                alpha[i], moved = new, max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def sigmoid_fit(margin: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton's method, with Platt's targets."""
    up, down = (labels == 1).sum(), (labels == 0).sum()
    t = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        theta = theta - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, x: np.ndarray) -> float:
        r = self.ratio[x]
        return float(self.weight[x] @ r / max(np.sqrt((r**2).sum()), 1e-12)) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -700, 700))))


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, **how) -> Model:
    """With rows of one class only (or none), every score is that class's smoothed share."""
    up, n = int((labels == 1).sum()), len(labels)
    if up in (0, n):
        p = (up + 1) / (n + 2)
        return Model(np.zeros(buckets), np.zeros(buckets), 0.0, 0.0, float(np.log(p / (1 - p))))

    def half(i: np.ndarray) -> Model:
        y, x = labels[i], [rows[k] for k in i]
        ratio = log_count_ratio(x, y, buckets)
        return Model(ratio, *dual_descent(x, y, ratio, **how), 1.0, 0.0)

    fold, margin = np.empty(n, int), np.empty(n)
    for side in (0, 1):  # folds hold the classes in equal parts
        at = np.flatnonzero(labels == side)
        fold[at] = np.arange(len(at)) % 2
    for k in (0, 1):
        i = np.flatnonzero(fold != k)
        if 0 < (labels[i] == 1).sum() < len(i):
            m = half(i)
            margin[fold == k] = [m.margin(rows[j]) for j in np.flatnonzero(fold == k)]
        else:
            margin[fold == k] = 0.0
    whole = half(np.arange(n))
    whole.a, whole.b = sigmoid_fit(margin, labels)
    return whole
