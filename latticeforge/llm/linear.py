"""Sparse linear classifiers: follow-the-regularised-leader training and temperature calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SparseRows:
    """Rows of (feature, value) pairs: row i owns the positions off[i]:off[i+1]."""

    index: np.ndarray
    value: np.ndarray
    off: np.ndarray

    def take(self, rows: np.ndarray) -> SparseRows:
        from ._kernels import ragged_index

        length = self.off[rows + 1] - self.off[rows]
        at = ragged_index(self.off[rows], length)
        return SparseRows(self.index[at], self.value[at], np.concatenate([[0], np.cumsum(length)]))


@dataclass(frozen=True)
class LinearModel:
    """Softmax over weights[c] . x + bias[c], divided by the temperature."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, rows: SparseRows) -> np.ndarray:
        row = np.repeat(np.arange(len(rows.off) - 1), np.diff(rows.off))
        return np.stack([np.bincount(row, w[rows.index] * rows.value, len(rows.off) - 1) + b for w, b in zip(self.weights, self.bias)], axis=1)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def train_ftrl(rows: SparseRows, labels: np.ndarray, subset: np.ndarray, classes: int, dimensions: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4, batch: int = 32, seed: int = 7) -> LinearModel:
    """Multinomial logistic regression on a subset of rows by FTRL-proximal with elastic-net penalties, in small batches.

    The last coordinate is the bias, which no penalty touches.
    """
    z = np.zeros((classes, dimensions + 1))
    n = np.zeros((classes, dimensions + 1))
    order = np.random.default_rng(seed)

    def weights_at(at: np.ndarray) -> np.ndarray:
        zs, free = z[:, at], at == dimensions
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - np.where(free, 0.0, l1), 0.0)
        return -shrunk / ((beta + np.sqrt(n[:, at])) / alpha + np.where(free, 0.0, l2))

    for _ in range(epochs):
        shuffled = order.permutation(subset)
        for at in range(0, len(shuffled), batch):
            own = shuffled[at : at + batch]
            part = rows.take(own)
            row = np.concatenate([np.repeat(np.arange(len(own)), np.diff(part.off)), np.arange(len(own))])
            index = np.concatenate([part.index, np.full(len(own), dimensions)])
            value = np.concatenate([part.value, np.ones(len(own))])
            features, place = np.unique(index, return_inverse=True)
            w = weights_at(features)
            logits = np.stack([np.bincount(row, w[c][place] * value, len(own)) for c in range(classes)], axis=1)
            error = softmax(logits)
            error[np.arange(len(own)), labels[own]] -= 1
            for c in range(classes):
                g = np.bincount(place, value * error[row, c], len(features))
                old = n[c, features]
                sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / alpha
                z[c, features] += g - sigma * w[c]
                n[c, features] = old + g * g
    final = weights_at(np.arange(dimensions + 1))
    return LinearModel(final[:, :-1].astype(np.float32), final[:, -1].copy())


def calibrated(model: LinearModel, rows: SparseRows, labels: np.ndarray) -> LinearModel:
    """The model with the temperature of least log loss on rows it was not trained on."""
    if not len(labels):
        return model
    logits = model.logits(rows)
    best = min(np.geomspace(0.05, 20, 121), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).sum())
    return LinearModel(model.weights, model.bias, float(best))


def fit(rows: SparseRows, labels: np.ndarray, classes: int, dimensions: int, **options) -> LinearModel:
    """Trains on four of five rows and calibrates on the fifth."""
    held = np.arange(len(labels)) % 5 == 4
    model = train_ftrl(rows, labels, np.flatnonzero(~held), classes, dimensions, **options)
    return calibrated(model, rows.take(np.flatnonzero(held)), labels[held])
