"""Further queries of the series operators: publication lags, comparisons, stitching, requests and whole runs, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import backtest as B
from augury.operators import combine as C
from augury.operators import evaluate as E
from augury.operators import series as S
from augury.plans import run as R
from augury.plans.catalogue import _R, _W, _X, _Y, K, _read, signal, target
from augury.plans.forecasts import _D, _all_orders, _daily, _packed, _preds
from augury.sinks import report as O


def _windows(s, d):
    """Three overlapping windows of the signals, each on a scale of its own."""
    x = signal(s, d)
    cuts = [(0, 23976, 4.0), (23964, 24000, 2.0), (23988, 99999, 1.0)]
    parts = [x.filter(F.col("pidx").between(a, b)).withColumn("v", F.col("v") * k).withColumn("window", F.lit(i)) for i, (a, b, k) in enumerate(cuts)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ends(s, d):
    w = _windows(s, d)
    return w.filter("window = 0"), w.filter("window = 1")


def _signals(s, d):
    return signal(s, d).select(F.lit("all").alias("key"), F.col("key").alias("keyword"), "pidx", "v")


def _spec(**more):
    return {"freq": "M", "min_train": 24, "horizons": [{"h": 1, "y_known": True}], "models": ["ridge+raw", "ridge+djorno_nocluster"], "exclude": [23980, 23985], **more}


def _run(s, d, table):
    return R.run(_all_orders(s, d), _signals(s, d), K, _spec())[table]


def _report(s, d):
    y = _all_orders(s, d)
    return O.outputs(R.run(y, _signals(s, d), K, _spec()), y, K, "Orders a month")


def _list(s, d):
    """Part brands as a request list with repeats, in the order of the parts."""
    return _read(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("keyword"))


def _low_high(s, d):
    days = _daily(s, d)
    return days.select("key", F.last_day("ds").alias("ds")).distinct(), days


def _contest(s, d):
    """Share of urgent among urgent and high orders by year and nation, against the margin of their prices."""
    o = _read(s, d, "orders").filter("o_orderpriority in ('1-URGENT', '2-HIGH')").join(_read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    up = F.col("o_orderpriority") == "1-URGENT"
    share = F.avg(up.cast("double"))
    margin = F.sum(F.when(up, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))) / F.sum("o_totalprice")
    o = o.withColumns({"year": F.year("o_orderdate").cast("long"), "place": F.col("c_nationkey").cast("long")})
    by = o.groupBy("year", "place").agg(share.alias("share"), margin.alias("margin"))
    nation = o.groupBy("year").agg(share.alias("nat_share"), margin.alias("nat_margin"))
    return C.contest(by.select("year", "place", "share"), by.filter("place <> 3").select("year", "place", "margin"), nation)


def _leakage(s, d):
    p = B.leakage(_all_orders(s, d), _signals(s, d), K, B.Plan(lags=2, models=("ar", "ridge")))
    return S.metrics(p, ["key", "alignment"], "ar").select("key", "alignment", "model", "n", "mae", "rmse", "oos_r2")


def _one_signal(s, d):
    """All orders beside the sum of the signals."""
    x = signal(s, d).groupBy("pidx").agg(F.sum("v").alias("v"))
    return B.pack(_all_orders(s, d), x.select(F.lit("all").alias("key"), F.lit("lines").alias("keyword"), "pidx", "v"), K)


QUERIES = {
    "benchmarks_h0": lambda s, d: _R(S.benchmarks(target(s, d), K, 0), "key", "pidx", "model", "y", "base", "p"),
    "benchmarks_lag": lambda s, d: _R(S.benchmarks(target(s, d), K, 2, known=False), "key", "pidx", "model", "y", "base", "p"),
    "compare": lambda s, d: _R(E.compare(S.benchmarks(target(s, d), K), K, "drift", target(s, d), 12), "key", "model", "n", "mae", "rmse", "mape", "oos_r2", "diracc", "mase", "dm_stat", "cw_stat"),
    "compare_excluded": lambda s, d: _R(E.compare(S.benchmarks(target(s, d), K), K, "drift", target(s, d), 12, window=(23970, 23990)), "key", "model", "n", "mae", "oos_r2"),
    "dm_absolute": lambda s, d: _R(E.diebold_mariano(_preds(s, d), K, "naive", 1, "absolute"), "key", "model", "n", "dm_stat"),
    "best_benchmark": lambda s, d: E.best_of(S.metrics(_preds(s, d), K), K, ["naive", "drift", "seasonal"]),
    "target_only": lambda s, d: _R(R.target_only(target(s, d), K, 2, 12), "key", "bench", "pidx", "p", "half"),
    "regime_change": lambda s, d: _R(E.regimes(_preds(s, d), K, "change"), "key", "model", "mae_high", "mae_low"),
    "state_conformal": lambda s, d: _R(E.state_conformal(_preds(s, d), K, 30.0), "key", "model", "n", "half"),
    "error_spread": lambda s, d: _R(E.error_spread(_preds(s, d), K), "key", "model", "sd"),
    "others_mean": lambda s, d: _R(E.others_mean(target(s, d), ["pidx"]), "key", "pidx", "v", "others"),
    "slope8": lambda s, d: _R(E.slope(target(s, d), K, 8), "key", "slope"),
    "change12": lambda s, d: _R(S.change(target(s, d), K, 12), "key", "pidx", "v"),
    "contiguous": lambda s, d: S.assert_contiguous(target(s, d), K).select("key", "pidx", "v"),
    "share_of_sums": lambda s, d: _R(S.share_of_sums(target(s, d), "key"), "key", "share"),
    "stitch_scales": lambda s, d: _R(S.stitch_scales(_windows(s, d), "key"), "key", "window", "n", "corr", "scale"),
    "stitch_many": lambda s, d: _R(S.stitch_many(_windows(s, d), "key"), "key", "pidx", "v"),
    "chain_means": lambda s, d: _R(S.chain_means(*_ends(s, d), "key"), "key", "scale", "corr"),
    "batches": lambda s, d: C.batches(_list(s, d), "Brand#11"),
    "individual": lambda s, d: C.individual(signal(s, d).withColumnRenamed("key", "keyword").withColumn("pos", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn("v", F.col("v") * F.col("pos"))),
    "union_columns": lambda s, d: C.union_columns(signal(s, d).withColumnRenamed("key", "keyword").withColumn("pos", F.lit(0)).filter("pidx % 5 <> length(keyword) % 2")),
    "extend": lambda s, d: C.extend(target(s, d), K, 3),
    "signal_info": lambda s, d: C.signal_info(signal(s, d), _all_orders(s, d), "key"),
    "drop_list": lambda s, d: signal(s, d).join(signal(s, d).select("key").distinct().filter("key like '%5'"), "key", "left_anti").select("key", "pidx", "v"),
    "exp_of_log": lambda s, d: _R(target(s, d).withColumn("v", F.exp(F.log("v"))), "key", "pidx", "v"),
    "clip": lambda s, d: _R(S.benchmarks(target(s, d), K).withColumn("p", F.greatest("p", F.lit(25.0))), "key", "pidx", "model", "p"),
    "records": lambda s, d: signal(s, d).groupBy("key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pidx", F.col("v").cast("long").alias("v"))))).alias("rows")),
    "two_views": lambda s, d: _run(s, d, "verdicts").select("key", "h", "model", "use"),
    "run_forecast": lambda s, d: _run(s, d, "forecasts"),
    "run_report": _report,
    "run_metrics": lambda s, d: _run(s, d, "metrics"),
    "selection_report": lambda s, d: B.selection_report(B.rolling(_packed(s, d), K, B.Plan(models=("arlr",), chunk=8)), K),
    "cluster_stability": lambda s, d: B.cluster_stability(_packed(s, d), K, 36),
    "midas_grid": lambda s, d: _R(C.midas_grid(*_low_high(s, d), K, 3), "key", "ds", "a", "b", "v"),
    "contest": lambda s, d: _R(_contest(s, d), "year", "place", "share", "margin", "hit", "rel_share", "rel_margin", "rel_hit"),
    "leakage": _leakage,
    "forest_backtest": lambda s, d: B.rolling(_packed(s, d), K, B.Plan(models=("rf",), chunk=1)),
    "arima_backtest": lambda s, d: _R(B.rolling(B.pack(target(s, d), None, K), K, B.Plan(models=("arima",))), "key", "model", "origin", "pidx", "y", "base", "p"),
    "arimax_backtest": lambda s, d: B.rolling(_one_signal(s, d), K, B.Plan(models=("arima", "arimax"), order=(1, 0, 1), seasonal=(1, 0, 0, 12), horizon=2, known=False, chunk=8)),
    "djorno_backtest": lambda s, d: B.rolling(_packed(s, d), K, B.Plan(lags=2, models=("ridge",), prep="djorno")),
}


def _lagged(h: int, late: int) -> str:
    """Benchmarks from the calendar itself: every past value is looked up by its period."""
    at = lambda n, j: f"LEFT JOIN y {n} ON {n}.key = y.key AND {n}.pidx = y.pidx - {j}"
    mean = f"(SELECT avg(b.v - a.v) FROM y a JOIN y b ON b.key = a.key AND b.pidx = a.pidx + 1 WHERE b.key = y.key AND b.pidx <= y.pidx - {late})"
    return f"""w AS (SELECT y.key, y.pidx, y.v AS y, o.v AS base, l.v AS nai, t.v AS sea, l.v + {late} * {mean} AS dri FROM y {at('o', max(h, 1))} {at('l', late)} {at('t', 12)}),
b AS (SELECT key, pidx, 'naive' AS model, y, base, nai AS p FROM w UNION ALL SELECT key, pidx, 'seasonal', y, base, sea FROM w UNION ALL SELECT key, pidx, 'drift', y, base, dri FROM w),
c AS (SELECT * FROM b WHERE p IS NOT NULL), j AS (SELECT * FROM c WHERE (key, pidx) IN (SELECT (key, pidx) FROM c GROUP BY key, pidx HAVING count(*) = 3))"""


_ALL = "t AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS pidx, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)"
_SCORE = """q AS (SELECT j.*, d.p AS f0 FROM j JOIN j d ON d.key = j.key AND d.pidx = j.pidx AND d.model = 'drift'),
h AS (SELECT a.key, avg(abs(a.v - b.v)) AS sc FROM y a JOIN y b ON a.key = b.key AND b.pidx = a.pidx - 12 GROUP BY 1),
e AS (SELECT *, (y - f0) ** 2 - (y - p) ** 2 AS d1, (y - f0) ** 2 - (y - p) ** 2 + (f0 - p) ** 2 AS d2 FROM q)"""
_WIN = """x3 AS (SELECT key, 0 AS w, pidx, v * 4 AS v FROM x WHERE pidx <= 23976 UNION ALL SELECT key, 1, pidx, v * 2 FROM x WHERE pidx BETWEEN 23964 AND 24000 UNION ALL SELECT key, 2, pidx, v FROM x WHERE pidx >= 23988),
r AS (SELECT o.key, o.w, count(*) AS n, corr(o.v, n.v) AS c, avg(n.v) FILTER (WHERE o.v > 0) / avg(o.v) FILTER (WHERE o.v > 0) AS r FROM x3 o JOIN x3 n ON o.key = n.key AND o.pidx = n.pidx AND n.w = o.w + 1 GROUP BY 1, 2),
z AS (SELECT k.key, k.w, coalesce(r.n, 0) AS n, CASE WHEN r.n > 3 THEN c END AS c, (SELECT coalesce(product(q.r), 1) FROM r q WHERE q.key = k.key AND q.w >= k.w) AS f FROM (SELECT DISTINCT key, w FROM x3) k LEFT JOIN r ON r.key = k.key AND r.w = k.w)"""

ORACLE_SQL = {
    "benchmarks_h0": f"WITH {_Y}, {_lagged(0, 1)} SELECT key, pidx, model, y, base, round(p, 6) AS p FROM c",
    "benchmarks_lag": f"WITH {_Y}, {_lagged(2, 3)} SELECT key, pidx, model, y, base, round(p, 6) AS p FROM c",
    "compare": f"""WITH {_Y}, {_lagged(1, 1)}, {_SCORE} SELECT key, model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs((y - p) / y)) * 100, 6) AS mape,
round(1 - sum((y - p) ** 2) / sum((y - f0) ** 2), 6) AS oos_r2, CASE WHEN count(*) FILTER (WHERE round(p - base, 10) <> 0) > 0 THEN round(avg(CASE WHEN sign(y - base) = sign(round(p - base, 10)) THEN 1.0 ELSE 0 END) FILTER (WHERE y <> base), 6) END AS diracc,
round(avg(abs(y - p)) / max(sc), 6) AS mase, CASE WHEN model <> 'drift' THEN round(avg(d1) / sqrt(greatest(var_pop(d1), 1e-18) / count(*)) * sqrt((count(*) - 1) / count(*)), 6) END AS dm_stat,
CASE WHEN model <> 'drift' THEN round(avg(d2) / sqrt(greatest(var_pop(d2), 1e-18) / count(*)), 6) END AS cw_stat FROM e JOIN h USING (key) GROUP BY 1, 2""",
    "compare_excluded": f"WITH {_Y}, {_lagged(1, 1)}, {_SCORE} SELECT key, model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) ** 2) / sum((y - f0) ** 2), 6) AS oos_r2 FROM e WHERE pidx NOT BETWEEN 23970 AND 23990 GROUP BY 1, 2",
    "dm_absolute": f"""WITH {_Y}, {_lagged(1, 1)}, a AS (SELECT j.key, j.model, abs(j.y - n.p) - abs(j.y - j.p) AS d FROM j JOIN j n ON n.key = j.key AND n.pidx = j.pidx AND n.model = 'naive' WHERE j.model <> 'naive')
SELECT key, model, count(*) AS n, round(avg(d) / sqrt(greatest(var_pop(d), 1e-18) / count(*)) * sqrt((count(*) - 1) / count(*)), 6) AS dm_stat FROM a GROUP BY 1, 2""",
    "best_benchmark": f"WITH {_Y}, {_lagged(1, 1)}, a AS (SELECT key, model, avg(abs(y - p)) AS m FROM j GROUP BY 1, 2) SELECT key, first(model ORDER BY m, strpos('naive drift seasonal', model)) AS bench FROM a GROUP BY 1",
    "target_only": f"""WITH {_Y}, {_lagged(2, 2)}, a AS (SELECT key, model, avg(abs(y - p)) AS m FROM j GROUP BY 1, 2), g AS (SELECT key, first(model ORDER BY m, strpos('naive drift seasonal', model)) AS bench FROM a GROUP BY 1),
l AS (SELECT y.key, max(pidx) AS e, arg_max(v, pidx) AS last, (SELECT avg(q.v - p.v) FROM y p JOIN y q ON q.key = p.key AND q.pidx = p.pidx + 1 WHERE p.key = y.key) AS mu FROM y GROUP BY y.key),
o AS (SELECT *, row_number() OVER (PARTITION BY key, model ORDER BY pidx DESC) AS r FROM j), s AS (SELECT key, model, list_sort(list(abs(y - p))) AS a FROM o WHERE r <= 60 GROUP BY 1, 2)
SELECT g.key, bench, e + 2 AS pidx, round(CASE bench WHEN 'naive' THEN last WHEN 'drift' THEN last + 2 * mu ELSE y.v END, 6) AS p, round(a[least(CAST(ceil(0.9 * (len(a) + 1)) AS BIGINT), len(a))], 6) AS half
FROM g JOIN l USING (key) JOIN s ON s.key = g.key AND s.model = bench LEFT JOIN y ON y.key = g.key AND y.pidx = e - 10""",
    "regime_change": f"WITH {_Y}, {_lagged(1, 1)}, m AS (SELECT key, median(abs(y - base)) AS med FROM (SELECT DISTINCT key, pidx, y, base FROM j) GROUP BY 1) SELECT key, model, round(avg(abs(y - p)) FILTER (WHERE abs(y - base) > med), 6) AS mae_high, round(avg(abs(y - p)) FILTER (WHERE abs(y - base) <= med), 6) AS mae_low FROM j JOIN m USING (key) GROUP BY 1, 2",
    "state_conformal": f"""WITH {_Y}, {_lagged(1, 1)}, o AS (SELECT *, row_number() OVER (PARTITION BY key, model ORDER BY pidx DESC) AS r FROM j WHERE base < 30), s AS (SELECT key, model, list_sort(list(abs(y - p))) AS a FROM o WHERE r <= 36 GROUP BY 1, 2)
SELECT key, model, CAST(len(a) AS BIGINT) AS n, round(a[least(CAST(ceil(0.9 * (len(a) + 1)) AS BIGINT), len(a))], 6) AS half FROM s""",
    "error_spread": f"WITH {_Y}, {_lagged(1, 1)} SELECT key, model, CASE WHEN count(*) > 5 THEN round(stddev_pop(y - p), 6) END AS sd FROM j GROUP BY 1, 2",
    "others_mean": f"WITH {_Y} SELECT a.key, a.pidx, a.v, round((SELECT avg(b.v) FROM y b WHERE b.pidx = a.pidx AND b.key <> a.key), 6) AS others FROM y a",
    "slope8": f"WITH {_Y}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pidx DESC) AS r FROM y) SELECT key, round(regr_slope(v, pidx), 6) AS slope FROM r WHERE r <= 8 GROUP BY 1",
    "change12": f"WITH {_Y} SELECT a.key, a.pidx, a.v - b.v AS v FROM y a LEFT JOIN y b ON a.key = b.key AND b.pidx = a.pidx - 12",
    "contiguous": f"WITH {_Y} SELECT key, pidx, v FROM y",
    "share_of_sums": f"WITH {_Y} SELECT key, round(sum(v) / (SELECT sum(v) FROM y), 6) AS share FROM y GROUP BY 1",
    "stitch_scales": f"WITH {_X}, {_WIN} SELECT key, w AS window, n, round(c, 6) AS corr, round(f, 6) AS scale FROM z",
    "stitch_many": f"WITH {_X}, {_WIN} SELECT key, pidx, round(arg_max(x3.v * f, w), 6) AS v FROM x3 JOIN z USING (key, w) GROUP BY 1, 2",
    "chain_means": f"WITH {_X}, {_WIN} SELECT a.key, round(avg(b.v) / avg(a.v), 6) AS scale, round(corr(a.v, b.v), 6) AS corr FROM x3 a JOIN x3 b ON a.key = b.key AND a.pidx = b.pidx AND a.w = 0 AND b.w = 1 GROUP BY 1",
    "batches": """WITH f AS (SELECT p_brand AS keyword, min(p_partkey) AS pos FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1), o AS (SELECT CAST((row_number() OVER (ORDER BY pos) - 1) // 4 AS INT) AS batch, keyword FROM f)
SELECT batch, keyword FROM o UNION ALL SELECT DISTINCT batch, 'Brand#11' FROM o""",
    "individual": f"WITH {_X} SELECT key AS keyword, pidx, v FROM x",
    "union_columns": f"WITH {_X}, k AS (SELECT key AS keyword, pidx, v FROM x WHERE pidx % 5 <> length(key) % 2) SELECT a.keyword, b.pidx, k.v FROM (SELECT DISTINCT keyword FROM k) a CROSS JOIN (SELECT DISTINCT pidx FROM k) b LEFT JOIN k ON k.keyword = a.keyword AND k.pidx = b.pidx",
    "midas_grid": f"""WITH {_D}, lo AS (SELECT DISTINCT key, last_day(ds) AS ds FROM n), j AS (SELECT lo.key, lo.ds, n.v, row_number() OVER (PARTITION BY lo.key, lo.ds ORDER BY n.ds DESC) - 1 AS j FROM lo JOIN n ON n.key = lo.key AND n.ds <= lo.ds),
g(a, b) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (-0.3, 0.0), (-0.7, 0.0), (0.3, -0.05), (0.0, -0.05), (-0.1, -0.02))
SELECT key, ds, a, b, round(sum(v * exp(a * j + b * j * j)) / sum(exp(a * j + b * j * j)), 6) AS v FROM j CROSS JOIN g WHERE j <= 3 GROUP BY 1, 2, 3, 4 HAVING count(*) = 4""",
    # An autoregression of order one by least conditional squares is a regression on the value before.
    "arima_backtest": f"""WITH {_Y}, i AS (SELECT *, row_number() OVER {_W}) - 1 AS i, lead(v) OVER {_W}) AS t, lead(pidx) OVER {_W}) AS tp FROM y),
f AS (SELECT *, regr_slope(t, v) OVER w AS s, regr_intercept(t, v) OVER w AS c FROM i WINDOW w AS {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, 'arima' AS model, pidx AS origin, tp AS pidx, t AS y, v AS base, round(c + s * v, 6) AS p FROM f WHERE i >= 24 AND t IS NOT NULL""",
    "contest": """WITH o AS (SELECT year(o_orderdate) AS year, c_nationkey AS place, o_totalprice AS t, o_orderpriority = '1-URGENT' AS up FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
n AS (SELECT year, avg(up::INT) AS ns, sum(CASE WHEN up THEN t ELSE -t END) / sum(t) AS nm FROM o GROUP BY 1),
p AS (SELECT year, place, avg(up::INT) AS share, CASE WHEN place <> 3 THEN sum(CASE WHEN up THEN t ELSE -t END) / sum(t) END AS margin FROM o GROUP BY 1, 2)
SELECT CAST(year AS BIGINT) AS year, CAST(place AS BIGINT) AS place, round(share, 6) AS share, round(margin, 6) AS margin, CASE WHEN share <> 0.5 THEN (share > 0.5) = (margin > 0) END AS hit,
round(share - ns, 6) AS rel_share, round(margin - nm, 6) AS rel_margin, CASE WHEN share <> ns THEN (share > ns) = (margin > nm) END AS rel_hit FROM p JOIN n USING (year)""",
    "extend": f"WITH {_Y} SELECT key, pidx, v FROM y UNION ALL SELECT key, unnest([max(pidx) + 1, max(pidx) + 2, max(pidx) + 3]), NULL FROM y GROUP BY key",
    "signal_info": f"""WITH {_X}, {_ALL}, c AS (SELECT key, pidx, v, v - lag(v) OVER {_W}) AS dx FROM x), u AS (SELECT pidx, v - lag(v) OVER (ORDER BY pidx) AS dy FROM t)
SELECT key, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END), 2) AS nonzero, round(corr(dx, dy), 2) AS corr FROM c LEFT JOIN u USING (pidx) GROUP BY 1""",
    "drop_list": f"WITH {_X} SELECT key, pidx, v FROM x WHERE key NOT LIKE '%5'",
    "exp_of_log": f"WITH {_Y} SELECT key, pidx, v FROM y",
    "clip": f"WITH {_Y}, {_lagged(1, 1)} SELECT key, pidx, model, round(greatest(p, 25), 6) AS p FROM c",
    "records": f"""WITH {_X} SELECT key, '[' || string_agg('{{"pidx":' || pidx || ',"v":' || CAST(v AS BIGINT) || '}}', ',' ORDER BY pidx) || ']' AS rows FROM x GROUP BY 1""",
}
