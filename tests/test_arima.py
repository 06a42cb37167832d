"""ARIMA errors against forms that are plain to compute."""

from dataclasses import replace

import numpy as np
import pytest

from augury.operators import arima as A
from augury.operators import backtest as B

NONE, RNG = (0, 0, 0, 0), np.random.default_rng
BARE = lambda n: np.zeros((n, 0))


def ahead(y, X, future, order, seasonal=NONE):
    return A.forecast(A.fit(y, X, order, seasonal), y, X, future, order, seasonal)


def test_autoregression_is_least_squares():
    y = RNG(0).normal(size=90).cumsum()
    Z = np.column_stack([np.ones(88), y[1:-1], y[:-2]])
    b = np.linalg.lstsq(Z, y[2:], rcond=None)[0]
    one = b @ [1, y[-1], y[-2]]
    assert ahead(y, BARE(90), BARE(1), (2, 0, 0)) == pytest.approx(one, abs=1e-6)
    assert ahead(y, BARE(90), BARE(2), (2, 0, 0)) == pytest.approx(b @ [1, one, y[-1]], abs=1e-6)


def test_differences():
    y = RNG(1).normal(size=60).cumsum()
    assert ahead(y, BARE(60), BARE(3), (0, 1, 0)) == pytest.approx(y[-1] + 3 * np.diff(y).mean())
    d = y[12:] - y[:-12]
    assert ahead(y, BARE(60), BARE(2), (0, 0, 0), (0, 1, 0, 12)) == pytest.approx(y[-11] + d.mean())
    assert ahead(y, BARE(60), BARE(1), (0, 1, 0), (0, 1, 0, 12)) == pytest.approx(y[-1] + y[-12] - y[-13] + np.diff(d).mean())


def test_moving_average_against_a_grid():
    e = RNG(2).normal(size=300)
    y = 5 + e
    y[1:] += 0.6 * e[:-1]
    got = A.fit(y, BARE(300), (0, 0, 1), NONE)

    def squares(c, m):
        last = total = 0.0
        for v in y:
            last = v - c - m * last
            total += last * last
        return total

    grid = [(squares(c, m), c, m) for c in np.linspace(4.5, 5.5, 21) for m in np.linspace(-0.9, 0.9, 37)]
    assert squares(*got) <= min(grid)[0]
    assert abs(got[1] - min(grid)[2]) <= 0.06
    last = 0.0
    for v in y:
        last = v - got[0] - got[1] * last
    assert A.forecast(got, y, BARE(300), BARE(1), (0, 0, 1), NONE) == pytest.approx(got[0] + got[1] * last)
    assert A.forecast(got, y, BARE(300), BARE(2), (0, 0, 1), NONE) == pytest.approx(got[0])


def test_signals():
    r = RNG(3)
    x, u = r.normal(size=(150, 1)), np.zeros(150)
    for t in range(1, 150):
        u[t] = 0.7 * u[t - 1] + r.normal() * 0.1
    y = 2 + 3 * x[:, 0] + u
    got = A.fit(y, x, (1, 0, 0), NONE)
    assert got[1] == pytest.approx(3, abs=0.05) and got[2] == pytest.approx(0.7, abs=0.15)
    near = A.forecast(got, y, x, np.array([[4.0]]), (1, 0, 0), NONE)
    assert near == pytest.approx(got[0] + 3 * 4 + got[2] * (y[-1] - 3 * x[-1, 0]), abs=0.3)


def test_origins_see_only_what_is_out():
    y, X = RNG(4).normal(size=60).cumsum() + 20, RNG(5).random((60, 1)) + 1
    for plan in (B.Plan(horizon=2), B.Plan(horizon=2, known=False), B.Plan(horizon=0)):
        for model in ("arima", "arimax"):
            p, _ = B.forecast_at(45, y, X, ["s"], np.arange(60), plan, model)
            later, signals = y.copy(), X.copy()
            later[46 if plan.known and plan.horizon else 45 :] += 100
            signals[46:] += 100
            assert B.forecast_at(45, later, signals, ["s"], np.arange(60), plan, model)[0] == p
    assert B.forecast_at(9, y, X, ["s"], np.arange(60), B.Plan(), "arima") is None
    assert B.forecast_at(45, y, X, ["s"], np.arange(60), replace(B.Plan(), window=30), "arimax")
