"""Multinomial logistic regression on a bounded sample, to calibrate scores."""

from __future__ import annotations

import numpy as np

#: Powers of a text's length by which summed scores are divided, tried in turn.
POWERS = (0.0, 0.5, 0.75, 1.0)


def logistic(z: np.ndarray, label: np.ndarray, classes: int, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Intercept and slopes of each class but the first, and the mean log loss, by Newton's method; each class counts one row more than it has, at z = 0."""
    k = z.shape[1]
    unit = np.maximum(np.abs(z).max(0, initial=0.0), 1e-12)
    x = np.concatenate([np.concatenate([np.ones((len(z), 1)), z / unit], 1), np.eye(1, k + 1).repeat(classes, 0)])
    y = np.eye(classes)[np.concatenate([label, np.arange(classes)])]
    beta = np.zeros((classes - 1, k + 1))

    def loss(b: np.ndarray) -> float:
        logits = np.concatenate([np.zeros((len(x), 1)), x @ b.T], 1)
        top = logits.max(1, keepdims=True)
        return float((np.log(np.exp(logits - top).sum(1)) + top[:, 0] - (logits * y).sum(1)).sum() + ridge * (b * b).sum() / 2)

    for _ in range(100):
        logits = np.concatenate([np.zeros((len(x), 1)), x @ beta.T], 1)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True))[:, 1:]
        slope = (x.T @ (p - y[:, 1:])).T + ridge * beta
        blocks = [[(x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x for j in range(len(beta))] for i in range(len(beta))]
        step = -np.linalg.solve(np.block(blocks) + ridge * np.eye(beta.size), slope.ravel()).reshape(beta.shape)
        size, here = 1.0, loss(beta)
        while loss(beta + size * step) > here and size > 1e-6:
            size /= 2
        beta = beta + size * step
        if here - loss(beta) < 1e-9 * max(1.0, here):
            break
    beta[:, 1:] /= unit
    return beta, loss(beta * np.concatenate([[1.0], unit])) / len(x)
