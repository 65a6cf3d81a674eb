"""Logistic calibration of one number, and a linear squared-hinge machine; both small and on the driver."""

from __future__ import annotations

import math


def logistic(values, labels, steps: int = 60, ridge: float = 1e-6) -> tuple[float, float]:
    """``(slope, intercept)`` of P(label 1) by damped Newton steps on standardised values.

    With one class only, or no values, the slope is 0 and the intercept its smoothed log odds.
    """
    import numpy as np

    x, y = np.asarray(values, dtype=float), np.asarray(labels, dtype=float)
    if len(x) < len(y) or len(y) == 0 or y.min() == y.max():
        ones = float(y.sum())
        return 0.0, math.log((ones + 0.5) / (len(y) - ones + 0.5))
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    rows, w = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - y) / len(y) + ridge * w * (1, 0)
        bend = (rows * (p * (1 - p))[:, None]).T @ rows / len(y) + np.diag((ridge, 1e-9))
        step = np.linalg.solve(bend, grad)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def logistic_many(rows, labels, steps: int = 80) -> tuple[list[float], float]:
    """``(weights, intercept)`` of P(label 1) from several numbers, by damped Newton steps.

    Columns are standardised; the weights are held back the more, the fewer rows there are (a ridge of
    one over their number). With one class only the weights are 0 and the intercept is its smoothed
    log odds.
    """
    import numpy as np

    x, y = np.asarray(rows, dtype=float), np.asarray(labels, dtype=float)
    ones = float(y.sum())
    if len(y) == 0 or y.min() == y.max():
        return [0.0] * (x.shape[1] if x.ndim == 2 else 0), math.log((ones + 0.5) / (len(y) - ones + 0.5))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    held, w = np.r_[np.full(x.shape[1], 1 / len(y)), 1e-9], np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(held), z.T @ (p - y) / len(y) + held * w)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return weights.tolist(), float(w[-1] - weights @ mean)


def probability(value: float, slope: float, intercept: float) -> float:
    z = slope * value + intercept
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def hinge_machine(rows, signs, counts, cost: float = 1.0, steps: int = 40):
    """Weights (the last one is the bias) of a squared-hinge linear SVM by Newton steps.

    A row counts as often as ``counts`` says; both classes count the same in all.
    """
    import numpy as np

    x = np.hstack([rows, np.ones((len(rows), 1))])
    y = np.asarray(signs, dtype=float)
    counts = np.asarray(counts, dtype=float)
    share = counts / np.where(y > 0, counts[y > 0].sum(), counts[y < 0].sum()) * cost
    w = np.zeros(x.shape[1])
    keep = np.diag(np.r_[np.ones(x.shape[1] - 1), 1e-6])
    loss = lambda v: v @ keep @ v / 2 + (share * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        grad = keep @ w - 2 * x[on].T @ (share * y * gap)[on]
        bend = keep + 2 * (x[on] * share[on][:, None]).T @ x[on]
        step = np.linalg.solve(bend, grad)
        if np.abs(step).max() < 1e-7:
            break
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
    return w
