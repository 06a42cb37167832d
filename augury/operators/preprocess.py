"""Preparation of signals inside one training window, in numpy: every step is fitted on the rows it is given, so that a backtest
that calls it with the rows up to an origin never sees later ones. Windows have hundreds of rows and tens of columns."""

from __future__ import annotations

import numpy as np

from augury.operators import models as M


def repair(X: np.ndarray, most: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(values, kept columns): columns with over ``most`` of zeros go, other zeros take the last value over zero, or else the next."""
    X = np.where(np.nan_to_num(X) > 0, X, np.nan)
    kept = np.isnan(X).mean(axis=0) <= most
    X = X[:, kept].copy()
    for rows in (X, X[::-1]):
        at = np.maximum.accumulate(np.where(np.isnan(rows), 0, np.arange(len(rows))[:, None]), axis=0)
        rows[:] = np.take_along_axis(rows, at, axis=0)
    return X, kept


def smooth(X: np.ndarray, halflife: float) -> np.ndarray:
    """Exponentially weighted mean of the rows so far."""
    if halflife <= 0:
        return X
    decay, out = 0.5 ** (1 / halflife), np.empty_like(X)
    total, weight = np.zeros(X.shape[1]), 0.0
    for i, row in enumerate(X):
        total, weight = total * decay + row, weight * decay + 1
        out[i] = total / weight
    return out


def _fill_back(X: np.ndarray) -> np.ndarray:
    known = np.flatnonzero(~np.isnan(X).any(axis=1))
    if len(known):
        X[: known[0]] = X[known[0]]
    return X


def detrend(X: np.ndarray, method: str | None, window: int = 12) -> np.ndarray:
    """Less the mean of the ``window`` rows before, the row before, or the line through all rows; first rows take the first known."""
    n = len(X)
    if method == "rolling":
        sums = np.vstack([np.zeros(X.shape[1]), np.cumsum(X, axis=0)])
        at = np.arange(n)
        lo = np.maximum(at - window, 0)
        count = at - lo
        base = np.full_like(X, np.nan)
        some = count >= max(2, window // 4)
        base[some] = (sums[at[some]] - sums[lo[some]]) / count[some, None]
        return _fill_back(X - base)
    if method == "diff":
        return _fill_back(np.vstack([np.full(X.shape[1], np.nan), np.diff(X, axis=0)]))
    if method == "linear":
        t = np.arange(n, dtype=float)
        if n < 3:
            return X - X.mean(axis=0)
        tc = t - t.mean()
        return X - X.mean(axis=0) - np.outer(tc, tc @ X / (tc @ tc))
    return X


def deseasonalize(X: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Less the mean of rows of the same position, plus the mean of all."""
    out = X + X.mean(axis=0)
    for at in np.unique(position):
        out[position == at] -= X[position == at].mean(axis=0)
    return out


def standardize(X: np.ndarray) -> np.ndarray:
    sd = X.std(axis=0)
    return (X - X.mean(axis=0)) / np.where(sd == 0, 1.0, sd)


def cluster_means(X: np.ndarray, names: list[str], threshold: float = 0.4, most: int | None = None) -> tuple[np.ndarray, list[str]]:
    """The mean of the standardised members of each cluster of alike columns; a cluster is named by its first member and the number of others."""
    labels, Z = np.array(M.cluster(X, threshold, most), int), standardize(X)
    groups = [np.flatnonzero(labels == g) for g in range(labels.max() + 1)] if len(labels) else []
    named = [names[g[0]] + (f"+{len(g) - 1}" if len(g) > 1 else "") for g in groups]
    return np.column_stack([Z[:, g].mean(axis=1) for g in groups]) if groups else Z, named


#: The kinds of preparation and their steps after repair and logarithm.
KINDS = {
    "none": (), "raw": (), "djorno": ("smooth", "rolling", "cluster"), "djorno_nocluster": ("smooth", "rolling", "standardize"), "diffgt": ("diff",),
}


def prepare(X: np.ndarray, names: list[str], kind: str, period: int, delta: float = 1.0) -> tuple[np.ndarray, list[str]]:
    """(values, names) of a window's signals: zeros repaired, logarithm of v + ``delta``, then the steps of ``kind``."""
    if kind == "none" or not X.shape[1]:
        return X, names
    X, kept = repair(X)
    names = [n for n, k in zip(names, kept) if k]
    X = np.log(X + delta)
    for step in KINDS[kind]:
        if not X.shape[1]:
            break
        if step == "smooth":
            X = smooth(X, 1.0 if period == 12 else 1.5)
        elif step in ("rolling", "diff", "linear"):
            X = detrend(X, step, period)
        elif step == "standardize":
            X = standardize(X)
        else:
            X, names = cluster_means(X, names)
    return X, names
