"""Follow-the-regularised-leader (proximal) for logistic and multinomial regression on sparse rows."""

from __future__ import annotations

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # feature numbers, distinct; their values


class Ftrl:
    """Weights of ``width`` features for ``classes`` outputs (1: logistic), with elastic-net penalties."""

    def __init__(self, width: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        kept = np.abs(z) > self.l1
        return np.where(kept, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, row: Row, target: np.ndarray) -> None:
        at, x = row
        w = self.weights(at)
        g = np.outer(x, chances(x @ w) - target)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def chances(scores: np.ndarray) -> np.ndarray:
    """Logistic of one score, softmax of several, along the last axis."""
    if scores.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -40, 40)))
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[Row], targets: np.ndarray, width: int, epochs: int, seed: int = 7, **options: float) -> np.ndarray:
    """Weights after ``epochs`` passes in a seeded order; ``targets`` has a row of outputs for each row."""
    model, rng = Ftrl(width, targets.shape[1], **options), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.learn(rows[i], targets[i])
    return model.weights(slice(None))
