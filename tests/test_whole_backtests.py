"""The registered backtests use every origin, and coordinate descent goes on until it settles."""

import numpy as np
import pytest

from augury.operators import backtest as B
from augury.operators import models as M
from augury.plans import forecasts


class Seen(Exception):
    pass


@pytest.mark.parametrize("query", ["penalised_backtest", "verdict"])
def test_every_origin_is_used(spark, monkeypatch, query):
    def rolling(packed, keys, plan):
        raise Seen(plan)

    monkeypatch.setattr(forecasts, "_packed", lambda s, d: None)
    monkeypatch.setattr(B, "rolling", rolling)
    with pytest.raises(Seen) as got:
        forecasts.QUERIES[query](spark, "")
    assert got.value.args[0].max_origins is None


def test_descent_settles_on_near_collinear_columns():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(60, 1))
    X = z + 0.04 * rng.normal(size=(60, 2))
    X, y = X - X.mean(0), (X @ [2.0, -1.0]) - (X @ [2.0, -1.0]).mean()
    gram, xy = X.T @ X / 60, X.T @ y / 60
    w = M._sparse(gram, xy, np.zeros(2), 0.0, 0.0)
    assert np.abs(w - [2, -1]).max() < 1e-3
