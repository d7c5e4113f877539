"""Small linear models, fitted on a bounded sample that fits in memory. Plain numpy; prediction runs in the tasks."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(gradient, width: int, steps: int, smooth: float) -> np.ndarray:
    """Nesterov's accelerated descent with a fixed step of 1 / `smooth`."""
    at = ahead = np.zeros(width)
    for k in range(steps):
        new = ahead - gradient(ahead) / smooth
        ahead = new + k / (k + 3) * (new - at)
        at = new
    return at


class Rows:
    """Rows of features and, last, a constant 1, for products with vectors from either side: a dense matrix, or the places
    of the ones in each row, with a few dense columns."""

    def __init__(self, dense: np.ndarray, ones: list[list[int]] | None = None, width: int = 0):
        self.dense = np.concatenate((dense, np.ones((len(dense), 1), dense.dtype)), axis=1)
        self.n, self.ones_width = len(dense), width
        self.width = width + self.dense.shape[1]
        self.columns = np.array([c for row in ones for c in row], np.int64) if ones is not None else None
        self.rows = np.repeat(np.arange(self.n), [len(row) for row in ones]) if ones is not None else None

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = (self.dense @ w[self.ones_width :].astype(self.dense.dtype)).astype(np.float64)
        return out if self.rows is None else out + np.bincount(self.rows, w[self.columns], self.n)

    def across(self, v: np.ndarray) -> np.ndarray:
        out = (self.dense.T @ v.astype(self.dense.dtype)).astype(np.float64)
        return out if self.rows is None else np.concatenate((np.bincount(self.columns, v[self.rows], self.ones_width), out))


def _smoothness(x: Rows, weight: np.ndarray) -> float:
    """The largest eigenvalue of the weighted Gram matrix, by power iteration, and some room."""
    v = np.full(x.width, x.width**-0.5)
    norm = 1.0
    for _ in range(12):
        v = x.across(weight * x.dot(v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    return 1.2 * norm


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear support vector machine with squared hinge loss; `y` is -1 or 1, and both
    classes weigh the same."""
    x = Rows(x)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    gradient = lambda w: ridge * w - 2 * x.across(weight * y * np.maximum(0, 1 - y * x.dot(w)))
    return _descend(gradient, x.width, steps, ridge + 2 * _smoothness(x, weight))


def fit_logistic(x: np.ndarray | Rows, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression; `y` lies in 0 to 1."""
    x = x if isinstance(x, Rows) else Rows(x)
    weight = np.ones(x.n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    gradient = lambda w: ridge * w + x.across(weight * (sigmoid(x.dot(w)) - y))
    return _descend(gradient, x.width, steps, ridge + 0.25 * _smoothness(x, weight))


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]
