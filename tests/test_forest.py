"""The forest's trees against trees grown whole, and the alignment check on a signal that shows the target."""

import numpy as np
import pytest

from augury.operators import backtest as B
from augury.operators import models as M


def whole(X, y, at, least):
    """A tree on all columns, every threshold tried."""
    best = (None, None, ((y - y.mean()) ** 2).sum() + 1)
    for j in range(X.shape[1]):
        values = np.unique(X[:, j])
        for edge in (values[1:] + values[:-1]) / 2:
            low = X[:, j] <= edge
            if least <= low.sum() <= len(y) - least:
                rss = sum(((part - part.mean()) ** 2).sum() for part in (y[low], y[~low]))
                if rss < best[2] - 1e-9:
                    best = (j, edge, rss)
    if best[0] is None or np.ptp(y) == 0:
        return y.mean()
    side = (X[:, best[0]] <= best[1]) == (at[best[0]] <= best[1])
    return whole(X[side], y[side], at, least)


@pytest.mark.parametrize("seed", range(6))
def test_path_equals_whole_tree(seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(40, 3)).round(1)
    y = rng.normal(size=40) + 2 * (X[:, 0] > 0)
    for at in rng.normal(size=(5, 3)):
        assert M.leaf(X, y, at, np.random.default_rng(0), 3, 1.0) == pytest.approx(whole(X, y, at, 3))


def test_forest():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 6))
    y = 10.0 * (X[:, 2] > 0)
    at = np.zeros(6)
    at[2] = 1.0
    assert M.forest(X, y, at) == M.forest(X, y, at) > 9
    assert M.forest(X, np.full(200, 4.0), at) == pytest.approx(4)
    assert M.forest(np.ones((20, 2)), np.arange(20.0), np.ones(2)) == pytest.approx(9.5, abs=1)


def test_leakage_shows(spark):
    v = np.random.default_rng(5).normal(size=80).cumsum() + 50
    y = spark.createDataFrame([("k", i, float(v[i])) for i in range(80)], "key string, pidx long, v double")
    # A signal that shows a period's value in that period: only a target labelled late finds its next value there.
    x = spark.createDataFrame([("k", "s", i, float(v[i])) for i in range(80)], "key string, keyword string, pidx long, v double")
    rows = B.leakage(y, x, ["key"], B.Plan(models=("ols",), prep="none")).collect()
    mae = {a: np.mean([abs(r.y - r.p) for r in rows if r.alignment == a]) for a in ("own", "late")}
    assert {r.alignment for r in rows} == {"own", "late"}
    assert mae["late"] < 1e-6 < 0.3 < mae["own"]
