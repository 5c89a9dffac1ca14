"""Small model fits on bounded samples, with NumPy."""

from __future__ import annotations

import numpy as np


def inverse_root(gram: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """K^(-1/2) of a kernel matrix among landmarks; directions without weight are dropped."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > floor * max(values.max(initial=0.0), 1e-30)
    return vectors[:, keep] / np.sqrt(values[keep])


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge SVM (labels -1 and 1) by Newton steps; returns (coefficients, offset)."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        margin = 1 - y * (design @ w)
        on = margin > 0
        active, scale = design[on], weight[on]
        grad = penalty * w - active.T @ (scale * y[on] * margin[on])
        hess = np.diag(penalty) + (active * scale[:, None]).T @ active
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression (labels 0 and 1) by damped Newton steps; the last coefficient is the offset."""
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(design.shape[1], ridge)
    w = np.zeros(design.shape[1])

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * v * v).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (weight * (p - y)) + penalty * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w
