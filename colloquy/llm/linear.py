"""Small fits on bounded samples: logistic regression, lasso logistic regression and squared-hinge linear machines."""

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method on few features. Returns weights and intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(penalty), gradient)
        w -= step * min(1, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_lasso_logistic(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on mean log loss + strength * |w|. The intercept is free."""
    n = max(1, len(x))
    rate = 1 / (0.25 * (np.linalg.norm(np.column_stack([x, np.ones(len(x))]), 2) ** 2) / n + 1e-12)
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    b = c = 0.0
    t = 1.0
    for _ in range(steps):
        error = (sigmoid(x @ v + c) - y) / n
        new = v - rate * (x.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * strength, 0)
        base = c - rate * error.sum()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (old - 1) / t * (new - w), base + (old - 1) / t * (base - b)
        w, b = new, base
    return w, float(b)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 150) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated gradient; y is -1 or 1, the last weight is the intercept."""
    a = np.column_stack([x, np.ones(len(x), x.dtype)])
    v = np.random.default_rng(0).normal(size=a.shape[1]).astype(x.dtype)
    for _ in range(12):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (1 + 2 * cost * float(np.linalg.norm(a @ v)) ** 2 * 1.05)
    w = u = np.zeros(a.shape[1], x.dtype)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (a @ u))
        new = u - rate * (u - 2 * cost * (a.T @ (slack * y)))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        u = new + x.dtype.type((old - 1) / t) * (new - w)
        w = new
    return w
