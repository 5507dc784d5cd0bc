"""Plain NumPy versions of the operators, one era at a time."""

import math
from statistics import NormalDist

import numpy as np

PPF = np.vectorize(NormalDist().inv_cdf)


def avg_rank(x):
    x = np.asarray(x, dtype=float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def gauss(x):
    return PPF((avg_rank(x) - 0.5) / len(x))


def p15(x):
    return np.sign(x) * np.abs(x) ** 1.5


def pearson(x, y):
    x, y = x - x.mean(), y - y.mean()
    d = np.linalg.norm(x) * np.linalg.norm(y)
    return 0.0 if d == 0 else float(x @ y / d)


def degenerate(*columns):
    return any(len(c) < 2 or np.std(c) == 0 for c in columns)


def corr(pred, target):
    if degenerate(pred, target):
        return 0.0
    return pearson(p15(gauss(pred)), p15(target - target.mean()))


def mmc(pred, meta, target):
    if degenerate(pred, meta, target):
        return 0.0
    p, m = gauss(pred), gauss(meta)
    rest = p - m * (p @ m) / (m @ m)
    t = target * 4 if ((target >= 0) & (target <= 1)).all() else target
    return float((t - t.mean()) @ rest / len(t))


def residual(pred, features):
    design = np.hstack([features, np.ones((len(features), 1))])
    return pred - design @ np.linalg.lstsq(design, pred, rcond=1e-6)[0]


def ac_sharpe(x, floor):
    x = np.asarray(x, dtype=float)
    n, c = len(x), x - np.mean(x)
    lags = min(max(math.floor(4 * (n / 100) ** (2 / 9)), floor), n - 1)
    if x.std() == 0:
        return 0.0
    total = sum((1 - k / (lags + 1)) * (c[:-k] @ c[k:]) / (c @ c) for k in range(1, lags + 1))
    return x.mean() / x.std() / math.sqrt(max(1 + 2 * total, 1e-12))

