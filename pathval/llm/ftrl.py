"""Follow-the-regularised-leader updates for logistic regression over sparse rows."""

from __future__ import annotations

import numpy as np


class Leader:
    """Per-coordinate FTRL-proximal with L1 and L2, for one or more outputs.

    ``z`` sums gradients less what moved the weights, ``n`` sums squared gradients; weights
    follow from both in closed form, so that L1 leaves exact zeros.
    """

    def __init__(self, width: int, outputs: int = 1, rate: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z = np.zeros((width, outputs))
        self.n = np.zeros((width, outputs))
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) > self.l1, shrunk / ((self.beta + np.sqrt(n)) / self.rate + self.l2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, wanted: np.ndarray, bias: float | np.ndarray = 0.0) -> None:
        """One row: the distinct coordinates ``at``, their values, and the wanted probabilities."""
        w = self.weights(at)
        g = np.outer(x, activate(x @ w + bias) - wanted)
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.rate * w
        self.n[at] = more


def activate(scores: np.ndarray) -> np.ndarray:
    """Sigmoid of a single score, softmax of several, along the last axis."""
    if scores.shape[-1] == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -60, 60)))
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
