"""A linear-chain conditional random field with two labels and sparse binary features, in numpy and plain Python."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    index: dict[str, int]
    emit: list[tuple[float, float]]
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def scores(self, seq: list[list[str]]) -> list[tuple[float, float]]:
        out = []
        for feats in seq:
            a = b = 0.0
            for f in feats:
                i = self.index.get(f)
                if i is not None:
                    e = self.emit[i]
                    a += e[0]
                    b += e[1]
            out.append((a, b))
        return out

    def decode(self, seq: list[list[str]]) -> list[int]:
        """Viterbi: the likeliest labels; ties go to 0."""
        if not seq:
            return []
        s, t, back = self.scores(seq), self.step, []
        v = (self.start[0] + s[0][0], self.start[1] + s[0][1])
        for a, b in s[1:]:
            from0 = (v[0] + t[0][0], v[1] + t[1][0])
            from1 = (v[0] + t[0][1], v[1] + t[1][1])
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            v = (max(from0) + a, max(from1) + b)
        label = [int(v[1] > v[0])]
        for pair in reversed(back):
            label.append(pair[label[-1]])
        return label[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, least: int = 3, seed: int = 7) -> Chain:
    """Maximum likelihood by AdaGrad, page by page; features seen in fewer than `least` blocks are left out."""
    seen: dict[str, int] = {}
    for seq, _ in pages:
        for feats in seq:
            for f in feats:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    data = [([[index[f] for f in feats if f in index] for feats in seq], np.array(y)) for seq, y in pages if seq]
    w, g2 = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-2)
    chain, c2 = np.zeros((3, 2)), np.full((3, 2), 1e-2)  # two rows of steps, one of starts
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            n = len(rows)
            s = np.array([w[r].sum(axis=0) for r in rows])
            node, edge = marginals(s, chain[:2], chain[2])
            grad = -node
            grad[np.arange(n), y] += 1
            flat = np.concatenate([np.array(r, int) for r in rows])
            where = np.repeat(np.arange(n), [len(r) for r in rows])
            at, inverse = np.unique(flat, return_inverse=True)
            step = np.zeros((len(at), 2))
            np.add.at(step, inverse, grad[where])
            step -= decay * w[at]
            g2[at] += step**2
            w[at] += rate * step / np.sqrt(g2[at])
            cg = np.zeros((3, 2))
            np.add.at(cg, (y[:-1], y[1:]), 1)
            cg[:2] -= edge
            cg[2] = -node[0]
            cg[2, y[0]] += 1
            cg -= decay * chain
            c2 += cg**2
            chain += rate * cg / np.sqrt(c2)
    pair = lambda r: (float(r[0]), float(r[1]))
    return Chain(index, [pair(r) for r in w], pair(chain[2]), (pair(chain[0]), pair(chain[1])))


def marginals(s: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each block, and expected numbers of steps, by forward and backward sums."""
    n = len(s)
    f, b = [None] * n, [None] * n
    f[0] = s[0] + start
    for i in range(1, n):
        p = f[i - 1]
        f[i] = np.array([_lse(p[0] + step[0, j], p[1] + step[1, j]) + s[i, j] for j in (0, 1)])
    b[n - 1] = np.zeros(2)
    for i in range(n - 2, -1, -1):
        q = b[i + 1] + s[i + 1]
        b[i] = np.array([_lse(step[j, 0] + q[0], step[j, 1] + q[1]) for j in (0, 1)])
    z = _lse(f[-1][0], f[-1][1])
    node = np.exp(np.array([x + y for x, y in zip(f, b, strict=True)]) - z)
    edge = np.zeros((2, 2))
    for i in range(1, n):
        edge += np.exp(f[i - 1][:, None] + step + (s[i] + b[i])[None, :] - z)
    return node, edge


def _lse(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))
