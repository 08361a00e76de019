"""Logistic regression on few columns, for calibrating scores."""

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Logistic:
    """Weights of standardised columns, fitted by Newton steps; rows may have weights."""

    def __init__(self, columns: np.ndarray, label: np.ndarray, ridge: float = 1e-3, steps: int = 25, weights: np.ndarray | None = None):
        share = np.ones(len(label)) if weights is None else weights / weights.mean()
        self.mean = columns.mean(axis=0)
        self.spread = np.maximum(columns.std(axis=0), 1e-9)
        x = self._scaled(columns)
        penalty = np.full(x.shape[1], ridge * len(x))
        penalty[0] = 1e-9
        self.weights = np.zeros(x.shape[1])
        for _ in range(steps):
            p = sigmoid(x @ self.weights)
            slope = x.T @ (share * (p - label)) + penalty * self.weights
            curve = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
            step = np.linalg.solve(curve, slope)
            self.weights -= step
            if np.abs(step).max() < 1e-9:
                break

    def _scaled(self, columns: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(columns)), (columns - self.mean) / self.spread])

    def predict(self, columns: np.ndarray) -> np.ndarray:
        return sigmoid(self._scaled(columns) @ self.weights)
