"""Forecast queries against their SQL, and models against plain numpy."""

import math
from dataclasses import replace

import duckdb
import numpy as np
import pandas as pd
import pytest

from augury.functions import stats
from augury.operators import backtest as B
from augury.operators import models as M
from augury.operators.preprocess import KINDS, prepare, repair
from augury.plans.forecasts import ORACLE_SQL, QUERIES
from test_catalogue import SF, norm


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "part", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cur = QUERIES[name](spark, SF), db.execute(ORACLE_SQL[name])
    got, want = norm([tuple(r) for r in df.collect()], df.columns), norm(cur.fetchall(), [c[0] for c in cur.description])
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0]) > 0
    assert got[0] == want[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    assert all(x is None or not isinstance(x, float) or math.isfinite(x) for r in rows for x in r)


def test_tails():
    assert stats.t_both(2.0, 10) == pytest.approx(0.07338803477074039, abs=1e-12)
    assert stats.binomial_least(21, 36, 0.5) == pytest.approx(sum(math.comb(36, k) for k in range(21, 37)) / 2**36, abs=1e-12)


def _data(n=80, p=6):
    r = np.random.default_rng(3)
    X = r.normal(size=(n, p))
    return X, 2 + X[:, 0] - 0.5 * X[:, 2] + 0.2 * r.normal(size=n)


def test_ridge_is_the_best_of_plain_leave_one_out():
    X, y = _data(40)
    Z = (X - X.mean(0)) / X.std(0)

    def fit(A, b, a):
        return np.linalg.solve((A - A.mean(0)).T @ (A - A.mean(0)) + a * np.eye(A.shape[1]), (A - A.mean(0)).T @ (b - b.mean()))

    def loo(a):
        e = 0
        for i in range(len(y)):
            k = np.arange(len(y)) != i
            w = fit(Z[k], y[k], a)
            e += (y[i] - y[k].mean() - (Z[i] - Z[k].mean(0)) @ w) ** 2
        return e

    best = min(M.RIDGE_ALPHAS, key=loo)
    assert M.ridge(X, y)[1:] == pytest.approx(fit(Z, y, best) / X.std(0), rel=1e-6)


def test_lasso_meets_its_optimality_conditions():
    X, y = _data()
    Z = (X - X.mean(0)) / X.std(0)
    w = M._path(Z, y, 1.0, [0.1])[0]
    grad = Z.T @ (y - w[0] - Z @ w[1:]) / len(y)
    assert np.all(np.abs(grad) <= 0.1 + 1e-4)
    assert grad[w[1:] != 0] == pytest.approx(0.1 * np.sign(w[1:][w[1:] != 0]), abs=1e-4)
    assert np.abs(M.lasso(X, y)[1:] - [1, 0, -0.5, 0, 0, 0]).max() < 0.1
    assert np.abs(M.enet(X, y)[1:] - [1, 0, -0.5, 0, 0, 0]).max() < 0.1


def test_greedy_selection_finds_the_two_true_columns():
    X, y = _data()
    chosen = set(np.flatnonzero(M.arlr(X, y)[1:]))
    assert {0, 2} <= chosen


def test_clusters():
    r = np.random.default_rng(1)
    a, b = r.normal(size=100), r.normal(size=100)
    Z = np.column_stack([a, b, a + 0.1 * r.normal(size=100), b + 0.1 * r.normal(size=100), np.ones(100)])
    assert M.cluster(Z) == [0, 1, 0, 1, 2]


def test_no_future_value_moves_a_forecast():
    r = np.random.default_rng(2)
    y, X, pidx = r.normal(size=60), r.random((60, 3)), np.arange(60)
    for known in (True, False):
        plan = B.Plan(horizon=2, lags=2, x_lags=1, known=known, diff=True, harmonics=1)
        names = ["a", "b", "c"]
        for prep in KINDS:
            p, _ = B.forecast_at(40, y, X, names, pidx, replace(plan, prep=prep), "ridge")
            y2, X2 = y.copy(), X.copy()
            y2[41 if known else 40 :] += 100
            X2[41:] += 100
            assert B.forecast_at(40, y2, X2, names, pidx, replace(plan, prep=prep), "ridge")[0] == p


def test_repair():
    X, kept = repair(np.array([[0.0, 0], [2, 0], [0, 0], [4, 1]]))
    assert kept.tolist() == [True, False] and X.tolist() == [[2], [2], [2], [4]]


def test_preparation_against_pandas():
    r = np.random.default_rng(5)
    X = r.gamma(2.0, 3.0, size=(70, 5)) * (r.random((70, 5)) > 0.1)
    X[:, 3] = X[:, 0] * 2 + 0.01 * r.random(70)
    Z = pd.DataFrame(X, columns=list("abcde"))
    Z = np.log(Z.mask(Z <= 0).ffill().bfill() + 1).ewm(halflife=1.0, adjust=True).mean()
    Z = (Z - Z.rolling(12, min_periods=3).mean().shift(1)).bfill()
    S = (Z - Z.mean()) / Z.std(ddof=0)
    assert np.allclose(prepare(X, list("abcde"), "djorno_nocluster", 12)[0], S)
    got, names = prepare(X, list("abcde"), "djorno", 12)
    assert "a+1" in names and np.allclose(got[:, names.index("a+1")], S[["a", "d"]].mean(axis=1))
    D = np.log(pd.DataFrame(X).mask(X <= 0).ffill().bfill() + 1).diff().bfill()
    assert np.allclose(prepare(X, list("abcde"), "diffgt", 12)[0], D)


def test_forward_nowcast(spark):
    rows = [("k", t, float(t % 5 + t)) for t in range(50)]
    y = spark.createDataFrame(rows, "key string, pidx long, v double")
    x = spark.createDataFrame([("k", w, t, float(1 + (t * m) % 7)) for w, m in (("a", 3), ("b", 2)) for t in range(51)], "key string, keyword string, pidx long, v double")
    plan = B.Plan(horizon=0, lags=2, models=("ridge",), known=False)
    short = B.forward(B.pack(y, x, ["key"]), ["key"], plan).first()
    assert (short.origin, short.pidx, short.nowcast) == (49, 50, False)
    ahead = y.unionByName(spark.createDataFrame([("k", 50, None)], y.schema))
    full = B.forward(B.pack(ahead, x, ["key"]), ["key"], plan).first()
    assert (full.origin, full.pidx, full.nowcast) == (50, 50, True) and set(full.features) <= {"a", "b"}
