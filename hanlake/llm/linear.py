"""Logistic regression over sparse rows, on a bounded sample."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, most: int, *key: str, count: int | None = None) -> DataFrame:
    """About ``most`` rows (all if there are fewer), chosen by a hash of the key, alike on every run."""
    count = rows.count() if count is None else count
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30)) < int(most / count * (1 << 30)))


def least_loss(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 60, memory: int = 6, enough: float = 3e-3) -> np.ndarray:
    """Where a smooth convex loss is least: limited-memory BFGS steps, halved until the loss falls, until a step gains
    less than ``enough`` of it. loss gives its value and slopes."""
    w, (value, slopes) = start, loss(start)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(steps):
        way, pulls = slopes.copy(), []
        for s, y, r in reversed(past):
            pulls.append(r * float(s @ way))
            way -= pulls[-1] * y
        way *= 1 / (past[-1][2] * float(past[-1][1] @ past[-1][1])) if past else min(1.0, 1 / max(1e-12, float(np.abs(slopes).sum())))
        for (s, y, r), pull in zip(past, reversed(pulls)):
            way += (pull - r * float(y @ way)) * s
        gain, length = float(slopes @ way), 1.0
        for _ in range(20):
            then = w - length * way
            found, slopes_then = loss(then)
            if found <= value - 1e-4 * length * gain:
                break
            length /= 2
        else:
            return w
        s, y = then - w, slopes_then - slopes
        if (curved := float(s @ y)) > 0:
            past.append((s, y, 1 / curved))
        done = value - found <= enough * max(abs(found), 1e-12)
        w, value, slopes = then, found, slopes_then
        if done:
            return w
    return w


def fit_shrunk(indices: list, values: list, targets: np.ndarray, width: int, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft targets in [0, 1]: Nesterov steps of a
    safe length on the mean loss; weights that the loss hardly needs stay small, as the steps are few."""
    if not len(targets):
        return np.zeros(width), 0.0
    sizes = np.array([len(x) for x in indices])
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.concatenate([np.asarray(x, np.int64) for x in indices]) if sizes.sum() else np.zeros(0, np.int64)
    val = np.concatenate([np.asarray(x, float) for x in values]) if sizes.sum() else np.zeros(0)
    norm = max(1e-9, float(np.bincount(row, val * val, len(sizes)).max(initial=0)) + 1)
    rate = 4 / norm
    mean = float(np.clip(targets.mean(), 1e-3, 1 - 1e-3))
    w, b = np.zeros(width), np.log(mean / (1 - mean))
    w_old, b_old = w, b
    for step in range(steps):
        push = step / (step + 3)
        w_at, b_at = w + push * (w - w_old), b + push * (b - b_old)
        z = np.bincount(row, val * w_at[col], len(sizes)) + b_at
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - targets) / len(targets)
        w_old, b_old = w, b
        w = w_at - rate * (np.bincount(col, val * g[row], width) + l2 * w_at)
        b = b_at - rate * g.sum()
    return w, float(b)
