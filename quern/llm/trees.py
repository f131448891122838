"""Gradient-boosted trees on small integer features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Least and greatest threshold that calibration may choose.
CUT_BOUNDS = 0.2, 0.55


@dataclass
class Boosted:
    """Trees of a fixed depth: features and thresholds by node, values by leaf; ``cut`` is the calibrated threshold."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    base: float
    cut: float = 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        depth = int(np.log2(self.values.shape[1]))
        for f, t, v in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            score += v[node - (len(f))]
        return 1 / (1 + np.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, doubtful: np.ndarray | None = None, trees: int = 100, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, held_out: float = 0.25, seed: int = 0) -> Boosted:
    """Log-loss boosting with exact splits on feature values (0 to 63); the threshold is calibrated on held-out rows.

    Held-out probabilities are averaged in equal-sized bins, made monotone (isotonic), and the cut is the lowest
    score at which a candidate is more likely right than wrong. ``doubtful`` marks rows that calibration leaves out.
    """
    x = x.clip(0, 63).astype(np.int64)
    order = np.random.default_rng(seed).permutation(len(x))
    out, own = order[: int(len(x) * held_out)], order[int(len(x) * held_out) :]
    # candidates alike in all features are one row with a weight
    xt, place = np.unique(x[own], axis=0, return_inverse=True)
    place = place.reshape(-1)
    true, every = np.bincount(place, y[own].astype(float)), np.bincount(place).astype(float)
    share = (true.sum() / max(1.0, every.sum())).clip(1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(xt), base)
    inner = 2**depth - 1
    width = x.shape[1]
    slots = xt + 64 * np.arange(width)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = true - every * p, every * p * (1 - p)
        f, t, v = np.zeros(inner, np.int64), np.full(inner, 63, np.int64), np.zeros(inner + 1)
        node = np.zeros(len(xt), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                # one histogram for all features
                at = slots[rows].ravel()
                gl = np.bincount(at, np.repeat(g[rows], width), 64 * width).reshape(width, 64).cumsum(1)[:, :-1]
                hl = np.bincount(at, np.repeat(h[rows], width), 64 * width).reshape(width, 64).cumsum(1)[:, :-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                j, i = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, i] > best:
                    best, f[k], t[k] = gain[j, i], j, i
            node[rows] = 2 * k + 1 + (xt[rows, f[k]] > t[k])
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        v = rate * gl / (hl + ridge)
        score += v[leaf]
        fs.append(f)
        ts.append(t)
        vs.append(v)
    model = Boosted(np.array(fs), np.array(ts), np.array(vs), base)
    if len(out):
        out = out if doubtful is None else out[~doubtful[out]]
        model.cut = calibrated_cut(model.probability(x[out]), y[out].astype(float))
    return model


def calibrated_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Lowest score whose isotonic frequency of true candidates exceeds one half."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest score
    for s, t in zip(p[order], y[order], strict=True):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, n2, _ = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
    # with few doubtful candidates the estimate is rough: it moves the cut within bounds
    good = [lo for t, n, lo in blocks if t / n > 0.5]
    bad = [b for b in blocks if b[0] / b[1] <= 0.5]
    if not good or not bad:
        return 0.5
    below = p[p < good[0]].max(initial=0.0)
    return float(np.clip((good[0] + below) / 2, *CUT_BOUNDS))
