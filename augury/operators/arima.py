"""Regression on signals with seasonal ARIMA errors, in numpy: one window in, one forecast out.

Fitted by least conditional squares: the first values of the differenced series are taken as given and innovations before them
as zero. Without moving averages this is the maximum of the likelihood given those values. Neither stationarity nor invertibility is
enforced."""

from __future__ import annotations

import numpy as np

Order = tuple[int, int, int]
Seasonal = tuple[int, int, int, int]


def _poly(coefs: np.ndarray, lag: int) -> np.ndarray:
    """1 - c1 B^lag - c2 B^(2 lag) ..."""
    out = np.zeros(len(coefs) * lag + 1)
    out[0] = 1.0
    out[lag::lag] = -coefs
    return out


def _differencing(order: Order, seasonal: Seasonal) -> np.ndarray:
    out = np.ones(1)
    for _ in range(order[1]):
        out = np.convolve(out, [1.0, -1.0])
    for _ in range(seasonal[1]):
        out = np.convolve(out, _poly(np.ones(1), seasonal[3]))
    return out


def _lagged(poly: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The polynomial in the lag applied to ``v``, where all its lags exist."""
    return np.convolve(v, poly, "valid") if len(v) >= len(poly) else np.zeros(0)


def _split(params: np.ndarray, k: int, order: Order, seasonal: Seasonal):
    """(constant, slopes of the signals, autoregressive and moving-average polynomials)."""
    p, P, q, s = order[0], seasonal[0], order[2], max(seasonal[3], 1)
    at = np.split(params[1:], np.cumsum([k, p, P, q]))
    ar = np.convolve(_poly(at[1], 1), _poly(at[2], s))
    return params[0], at[0], ar, np.convolve(_poly(-at[3], 1), _poly(-at[4], s))


def innovations(params: np.ndarray, y: np.ndarray, X: np.ndarray, order: Order, seasonal: Seasonal) -> np.ndarray:
    c, slopes, ar, ma = _split(params, X.shape[1], order, seasonal)
    e = _lagged(ar, _lagged(_differencing(order, seasonal), y - X @ slopes)) - c
    if len(ma) > 1:
        back = ma[:0:-1]
        e = np.concatenate([np.zeros(len(back)), e])
        for t in range(len(back), len(e)):
            e[t] -= back @ e[t - len(back) : t]
        e = e[len(back) :]
    return e


def fit(y: np.ndarray, X: np.ndarray, order: Order, seasonal: Seasonal, most: int = 200) -> np.ndarray:
    """Parameters of least squared innovations by damped Gauss-Newton steps."""
    k, diff = X.shape[1], _differencing(order, seasonal)
    w = _lagged(diff, y)
    Z = np.column_stack([np.ones(len(w)), *[_lagged(diff, X[:, j]) for j in range(k)]])
    start = np.linalg.lstsq(Z, w, rcond=None)[0]
    now = np.concatenate([start, np.zeros(order[0] + seasonal[0] + order[2] + seasonal[2])])
    step = np.where(np.arange(len(now)) <= k, np.maximum(np.abs(now), 1.0) * 1e-6, 1e-6)
    e, damp = innovations(now, y, X, order, seasonal), 1e-3
    for _ in range(most):
        jac = np.column_stack([(innovations(now + step * u, y, X, order, seasonal) - innovations(now - step * u, y, X, order, seasonal)) / (2 * step[i]) for i, u in enumerate(np.eye(len(now)))])
        gram, slope = jac.T @ jac, jac.T @ e
        scale = np.diag(gram) + 1e-12
        while damp < 1e12:
            new = now - np.linalg.lstsq(gram + damp * np.diag(scale), slope, rcond=None)[0]
            with np.errstate(over="ignore", invalid="ignore"):
                f = innovations(new, y, X, order, seasonal)
                better = np.isfinite(f).all() and f @ f < e @ e
            if better:
                break
            damp *= 10
        else:
            break
        done = e @ e - f @ f <= 1e-13 * (e @ e)
        now, e, damp = new, f, max(damp / 10, 1e-15)
        if done:
            break
    return now


def forecast(params: np.ndarray, y: np.ndarray, X: np.ndarray, ahead: np.ndarray, order: Order, seasonal: Seasonal) -> float:
    """The value ``len(ahead)`` steps after ``y``; ``ahead`` has the signals of those steps."""
    c, slopes, ar, ma = _split(params, X.shape[1], order, seasonal)
    whole = np.convolve(ar, _differencing(order, seasonal))
    u, e = list(y - X @ slopes), list(innovations(params, y, X, order, seasonal))
    for _ in range(len(ahead)):
        past = sum(-a * u[-j] for j, a in enumerate(whole[1:], 1))
        u.append(c + past + sum(m * e[-j] for j, m in enumerate(ma[1:], 1) if j <= len(e)))
        e.append(0.0)
    return float(u[-1] + ahead[-1] @ slopes)


def needed(k: int, order: Order, seasonal: Seasonal) -> int:
    """Least rows of a window: those that lags use up, one a parameter, and eight."""
    p, d, q = order
    P, D, Q, s = seasonal
    return d + p + (D + P) * s + 1 + k + p + q + P + Q + 8
