"""Least squares on sums of products, and the basis that choices regress on."""

from __future__ import annotations

import numpy as np


def basis(xs: list[np.ndarray], size: int) -> np.ndarray:
    """Columns 1, x, x^2 and the products of different x."""
    cols = [np.ones(size), *xs, *(x * x for x in xs)]
    cols += [xs[i] * xs[j] for i in range(len(xs)) for j in range(i + 1, len(xs))]
    return np.stack(cols, axis=1)


def solve(gram: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Coefficients of least norm from X'X and X'Y; terms are scaled to unit size first."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    found, *_ = np.linalg.lstsq(gram / np.outer(scale, scale), moments / scale[:, None], rcond=1e-12)
    return found / scale[:, None]


def least_squares(xs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Fitted values of ``y`` on the basis of ``xs``; more terms than rows give an exact fit."""
    if any(len(x) != len(y) for x in xs):
        raise ValueError("regressors and target differ in length")
    x = basis(list(map(np.asarray, xs)), len(y))
    return x @ np.linalg.lstsq(x, np.asarray(y, float), rcond=None)[0]
