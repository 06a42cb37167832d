"""The further series queries against their SQL, and operators against small examples."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from augury.functions import text as T
from augury.operators import evaluate as E
from augury.operators import series as S
from augury.plans import run as R
from augury.plans.extended import ORACLE_SQL, QUERIES
from test_catalogue import SF, norm


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cur = QUERIES[name](spark, SF), db.execute(ORACLE_SQL[name])
    got, want = norm([tuple(r) for r in df.collect()], df.columns), norm(cur.fetchall(), [c[0] for c in cur.description])
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0]) > 0
    assert got[0] == want[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).collect()


def frame(spark, values, start=0):
    return spark.createDataFrame([("k", start + i, None if v is None else float(v)) for i, v in enumerate(values)], "key string, pidx long, v double")


def test_smooth_skips_nulls_and_long_series(spark):
    v = np.random.default_rng(0).normal(size=2500)
    v[np.random.default_rng(1).random(2500) < 0.2] = np.nan
    v[50:1400] = np.nan
    for halflife in (0.7, 1.5, 2.0):
        got = S.smooth(frame(spark, [None if np.isnan(x) else x for x in v]), ["key"], halflife).orderBy("pidx").toPandas().v.to_numpy(float)
        assert np.allclose(got, pd.Series(v).ewm(halflife=halflife, adjust=True).mean(), equal_nan=True)


def test_nowcast_does_not_see_its_target(spark):
    rows = S.benchmarks(frame(spark, [3, 5, 4, 9]), ["key"], 0, 2).filter("model = 'naive'").orderBy("pidx").collect()
    assert [(r.y, r.p, r.base) for r in rows] == [(5, 3, 3), (4, 5, 5), (9, 4, 4)]


def test_lags_keep_to_the_calendar(spark):
    gap = frame(spark, [1, 2, 3]).unionByName(frame(spark, [8, 9], 5))
    assert {r.pidx for r in S.benchmarks(gap, ["key"], 1).filter("model = 'naive'").collect()} == {1, 2, 6}
    with pytest.raises(Exception, match="gap"):
        S.assert_contiguous(gap, ["key"]).collect()


def test_no_change_has_no_direction_and_short_trend(spark):
    m = {r.model: r for r in S.metrics(S.common_sample(S.benchmarks(frame(spark, range(30)), ["key"], 1, 3), ["key"]), ["key"]).collect()}
    assert m["naive"].diracc is None and m["drift"].diracc == 1.0 and m["naive"].oos_r2 == 0.0
    assert [r.v for r in S.detrend(frame(spark, [4]), ["key"], "linear").collect()] == [0.0]
    assert [r.v for r in S.detrend(frame(spark, [4, 8]), ["key"], "linear").orderBy("pidx").collect()] == [-2.0, 2.0]


def test_request_names(spark):
    df = spark.createDataFrame([("résumé  flu--x!",), ("שפעת חום",), ("!!",), ('a"b\\c',)], "s string")
    rows = df.select(T.slugify(F.col("s")).alias("slug"), T.request_key(F.array("s"), F.lit("us "), F.lit("today 5-y")).alias("key")).collect()
    # The names and keys of these requests.
    assert [tuple(r) for r in rows] == [("résumé-flu-x", "cd5ec13fd0"), ("שפעת-חום", "16cc4c19bf"), ("q", "a703561769"), ("a-b-c", "0278221872")]
    cached = spark.range(1).select(T.cache_key(*[F.lit(x) for x in ("related_queries", "flu", "US", "today 5-y")])).first()[0]
    assert cached == "d7cb7120be" and T.timeframe_for("W", "2026-01-01") == "today 5-y"


def test_confidence_and_views(spark):
    full = spark.createDataFrame([("a", "m", "strong"), ("b", "m", "strong"), ("c", "m", "moderate"), ("d", "m", "none")], "key string, model string, strength string")
    view = spark.createDataFrame([("a", "none"), ("b", "strong"), ("c", "none"), ("d", "none")], "key string, strength string")
    regime = spark.createDataFrame([("b", 1.0, 2.0), ("c", 1.0, 2.0), ("d", 1.0, 2.0)], "key string, bench_mae double, model_mae double")
    got = {r.key: r.confidence for r in E.confidence(full, view, ["key"], regime).collect()}
    assert got == {"a": "medium", "b": "medium", "c": "low", "d": "low"}
    assert {r.key: r.use for r in E.in_both_views(full, view, ["key"]).collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_up_probability_and_rule(spark):
    p = spark.range(1).select(E.up_probability(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("p"), E.up_probability(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("q")).first()
    assert p.p == pytest.approx(0.5 * math.erfc(-1 / math.sqrt(2))) and p.q is None
    t = spark.createDataFrame([(12, 0.01, 0.9), (12, 0.01, 0.2), (7, 0.001, 0.99)], "n long, p_half double, r double")
    assert [r.passes for r in E.validated(t).collect()] == [True, False, False]


def test_run_end_to_end(spark):
    r = np.random.default_rng(4)
    x = r.gamma(4.0, 5.0, size=(90, 2))
    y = np.cumsum(r.normal(size=90)) * 0.1 + 20 + 0.8 * np.log1p(x[:, 0])
    target = spark.createDataFrame([("k", 100 + t, float(v)) for t, v in enumerate(y) if t != 40], "key string, pidx long, v double")
    signals = spark.createDataFrame([("k", w, 100 + t, float(x[t % 90, j])) for j, w in enumerate("ab") for t in range(91)], "key string, keyword string, pidx long, v double")
    spec = {"freq": "M", "min_train": 36, "models": ["ols+raw", "ridge+djorno"], "windows": [None, 40], "exclude": [150, 155], "clip_min": 0, "transform": None}
    out = R.run(target, signals, ["key"], spec)
    metrics = {(m.h, m.model): m for m in out["metrics"].collect()}
    assert {m for _, m in metrics} == {"naive", "drift", "seasonal", "ar", "ols+raw", "ols+raw@w40", "ridge+djorno", "ridge+djorno@w40"}
    preds = out["predictions"].filter("h = 0 and model = 'ols+raw'").toPandas()
    assert metrics[0, "ols+raw"].mae <= np.abs(preds.y - preds.p).max()
    verdicts = {v.h: v for v in out["verdicts"].collect()}
    assert verdicts[0].chosen == "ols+raw" and verdicts[0].strength == "strong" and verdicts[0].use
    f = {x.h: x for x in out["forecasts"].collect()}
    assert f[0].pidx == 190 and f[0].nowcast and f[1].pidx == 190 and f[0].lo <= f[0].p <= f[0].hi and "a" in f[0].features
    assert out["signals"].count() == 2
