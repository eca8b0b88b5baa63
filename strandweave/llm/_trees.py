"""Small fits on a bounded sample: boosted trees on binned features, and isotonic calibration."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0) -> dict:
    """Logistic boosting: each tree splits level by level on the best second-order gain over histogram bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # a feature that is zero in most rows needs a cut just above zero
    cuts = [np.unique(np.append(c, [0.0])) for c in cuts]
    cuts = [np.unique(np.append(c, np.quantile(x[x[:, j] > c[-1], j], [0.25, 0.5, 0.75]) if (x[:, j] > c[-1]).any() else [])) for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), base)
    model = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        splits = []
        for level in range(depth):
            n = 1 << level
            gain, col, cut = np.full(n, 1e-9), np.zeros(n, np.int64), np.full(n, width)
            for j in range(x.shape[1]):
                key = node * width + binned[:, j]
                gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                cs = np.bincount(key, minlength=n * width).reshape(n, width).cumsum(1)
                ga, ha, ca = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                v = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                v[(cs < least) | (ca - cs < least)] = -1
                at = v.argmax(1)
                best = v[np.arange(n), at]
                better = best > gain
                gain[better], col[better], cut[better] = best[better], j, at[better]
            splits.append((col, np.array([cuts[c][t] if t < len(cuts[c]) else np.inf for c, t in zip(col, cut, strict=True)])))
            node = node * 2 + (binned[np.arange(len(y)), col[node]] > cut[node])
        n = 1 << depth
        leaf = rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + ridge)
        f += leaf[node]
        model.append((splits, leaf))
    return {"base": base, "trees": model}


def predict_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of each row."""
    f = np.full(len(x), model["base"])
    every = np.arange(len(x))
    for splits, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for col, cut in splits:
            node = node * 2 + (x[every, col[node]] > cut[node])
        f += leaf[node]
    return f


def fit_isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (scores, probabilities) to interpolate between."""
    order = np.argsort(f, kind="stable")
    f, y = f[order], y[order]
    level: list[list[float]] = []  # value, weight, first score, last score
    for a, b in zip(f, y, strict=True):
        level.append([b, 1.0, a, a])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v, w, _, hi = level.pop()
            u = level[-1]
            u[0], u[1], u[3] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, hi
    xs = np.array([x for u in level for x in (u[2], u[3])])
    ys = np.array([u[0] for u in level for _ in (0, 1)])
    return xs, np.clip(ys, 0.0, 1.0)


def predict_isotonic(model: tuple[np.ndarray, np.ndarray], f: np.ndarray) -> np.ndarray:
    return np.interp(f, *model)
