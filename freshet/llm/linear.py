"""Training of linear models on sparse rows held by the driver: logistic and non-negative PU losses, calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


CHUNK = 1 << 19  # numbers handled at once, so that temporary arrays stay small


@dataclass
class Rows:
    """Sparse rows, one after another."""

    number: np.ndarray
    value: np.ndarray
    starts: np.ndarray  # of each row, and the end of the last

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        sizes = [len(n) for n, _ in rows]
        none = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        return cls(np.concatenate(none[0] + [n for n, _ in rows]), np.concatenate(none[1] + [v for _, v in rows]), np.append(0, np.cumsum(sizes, dtype=np.int64)))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def chunks(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Rows by chunk: which rows, which numbers, and each number's row within the chunk."""
        low = 0
        while low < len(self):
            high = max(low + 1, int(np.searchsorted(self.starts, self.starts[low] + CHUNK, "right")) - 1)
            yield slice(low, high), slice(self.starts[low], self.starts[high]), np.repeat(np.arange(high - low), np.diff(self.starts[low : high + 1]))
            low = high

    def product(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for rows, at, owner in self.chunks():
            out[rows] = np.bincount(owner, weights=self.value[at] * weights[self.number[at]], minlength=rows.stop - rows.start)
        return out

    def back(self, g: np.ndarray, dim: int) -> np.ndarray:
        """The product of the transposed rows with `g`."""
        out = np.zeros(dim)
        for rows, at, owner in self.chunks():
            out += np.bincount(self.number[at], weights=self.value[at] * g[rows][owner], minlength=dim)
        return out


def descend(gradient: Callable[[int, np.ndarray, float], tuple[np.ndarray, float]], dim: int, steps: int, rate: float, decay: float, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Adam. `gradient` gives, from the step's number (from 0), weights and bias, the derivative of the loss by both."""
    weights, bias = (start[0].astype(np.float32), start[1]) if start else (np.zeros(dim, np.float32), 0.0)
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for step in range(1, steps + 1):
        by_weights, by_bias = gradient(step - 1, weights, bias)
        full = np.append(by_weights + decay * weights, by_bias)
        m = 0.9 * m + 0.1 * full
        v = 0.99 * v + 0.01 * full**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        weights -= move[:-1].astype(np.float32)
        bias -= move[-1]
    return weights, float(bias)


def minimise(rows: Rows, gradient: Callable[[np.ndarray], np.ndarray], dim: int, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Descent over all rows at each step. `gradient` gives, from the rows' products, the derivative of the loss by each."""

    def full(_: int, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        g = gradient(rows.product(weights) + bias)
        return rows.back(g, dim), g.sum()

    return descend(full, dim, steps, rate, decay)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift that calibrate products `z` to the labels, by Newton steps with smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()
        haa, hab, hbb = (w * z * z).sum() + 1e-3, (w * z).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
    return float(max(a, 1e-3)), float(b)
