"""Queries of forecast tests, combination operators and model backtests, with SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from augury.functions import text as T
from augury.operators import backtest as B
from augury.operators import combine as C
from augury.operators import evaluate as E
from augury.operators import series as S
from augury.plans.catalogue import _B, _R, _W, _X, _Y, K, _read, signal, target
from augury.sources.files import written


def _preds(s, d):
    return S.common_sample(S.benchmarks(target(s, d), K), K)


def _daily(s, d):
    o = _read(s, d, "orders").withColumnRenamed("o_orderpriority", "key")
    return o.groupBy("key", F.to_date("o_orderdate").alias("ds")).agg(F.count("*").cast("double").alias("v"))


def _asof(s, d):
    days = _daily(s, d)
    low = days.select("key", F.last_day("ds").alias("ds")).distinct()
    return C.asof_lags(low, days, K, 3, WEIGHTS)


def _weeks(s, d):
    return S.period_aggregate(_read(s, d, "events").withColumnRenamed("event_type", "key"), K, "ts", F.count("*").cast("double"), "week")


def _batches(s, d):
    """Brands in batches of four, each with the anchor Brand#11 and on a scale of its own."""
    x = signal(s, d).withColumnRenamed("key", "keyword")
    batch = F.expr("cast(floor(cast(substr(keyword, 7, 2) as int) / 4) as int)")
    own = x.filter("keyword <> 'Brand#11'").withColumn("batch", batch)
    n = own.select("batch").distinct()
    anchor = x.filter("keyword = 'Brand#11'").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(24)))).join(n, "batch", "left_semi")
    return own.unionByName(anchor.select(*own.columns)).withColumn("v", F.col("v") / (1 + F.col("batch")))


def _all_orders(s, d):
    return S.period_aggregate(_read(s, d, "orders").withColumn("key", F.lit("all")), K, "o_orderdate", F.count("*").cast("double"))


def _packed(s, d):
    y = _all_orders(s, d)
    x = signal(s, d).select(F.lit("all").alias("key"), F.col("key").alias("keyword"), "pidx", "v")
    return B.pack(y, x, K)


def _old_new(s, d):
    x = signal(s, d)
    return x.filter("pidx < 23988"), x.filter("pidx >= 23976").withColumn("v", F.col("v") + 1)


def _verdicts(s, d):
    p = B.rolling(_packed(s, d), K, B.Plan(lags=2, models=("ar", "ridge", "arlr"))).drop("chosen", "origin")
    # The fits are written once; the scores and both tests read them.
    return E.verdict(E.compare(written(p), K, "ar", _all_orders(s, d), 12), K, ["ridge", "arlr"])


WEIGHTS = [math.exp(0.1 * j - 0.2 * j * j) for j in range(4)]
_months = lambda c: F.pmod(F.col(c) - 1, F.lit(12)) + 1

QUERIES = {
    "dm_test": lambda s, d: _R(E.diebold_mariano(_preds(s, d), K, "naive", 3), "key", "model", "n", "dm_stat"),
    "cw_test": lambda s, d: _R(E.clark_west(_preds(s, d), K, "naive", 3), "key", "model", "n", "cw_stat"),
    "test_p_values": lambda s, d: E.diebold_mariano(_preds(s, d), K, "naive").join(E.clark_west(_preds(s, d), K, "naive").drop("n"), ["key", "model"]),
    "directions": lambda s, d: _R(E.directions(_preds(s, d), K), "key", "model", "n", "hits", "base_up", "rate", "p_half"),
    "mase": lambda s, d: _R(E.mase(_preds(s, d), target(s, d), K, 12), "key", "model", "mase"),
    "regime_split": lambda s, d: _R(E.regimes(_preds(s, d), K), "key", "model", "mae_high", "mae_low"),
    "season_split": lambda s, d: _R(E.seasons(_preds(s, d), K, _months("pidx")), "key", "model", "rmse_cold", "rmse_warm"),
    "error_concentration": lambda s, d: _R(E.concentration(_preds(s, d), K, 23970, 23990), "key", "model", "inside"),
    "exclusion_window": lambda s, d: E.exclude(_preds(s, d), 23970, 23990).groupBy("key", "model").agg(F.count("*").alias("n")),
    "rolling_coverage": lambda s, d: _R(E.rolling_coverage(_preds(s, d), K, 24), "key", "model", "n", "coverage"),
    "rank_correlation": lambda s, d: _R(E.rank_correlation(_preds(s, d), ["key", "model"], "y", "p"), "key", "model", "n", "pearson", "spearman"),
    "derive_pct": lambda s, d: _R(C.derive(signal(s, d), K, "pct_change", 100), "key", "pidx", "v"),
    "derive_logdiff": lambda s, d: _R(C.derive(signal(s, d), K, "logdiff", 100), "key", "pidx", "v"),
    "fourier": lambda s, d: _R(C.fourier(target(s, d), 12, 2), "key", "pidx", "sin1", "cos1", "sin2", "cos2"),
    "normalise": lambda s, d: C.normalise(target(s, d), ["key"]).select("key", "pidx", "v"),
    "asof_lags": lambda s, d: _R(_asof(s, d), "key", "ds", "v"),
    "anchored": lambda s, d: _R(C.anchored(_batches(s, d), "Brand#11"), "keyword", "pidx", "v"),
    "splice": lambda s, d: C.splice(*_old_new(s, d), K).select("key", "pidx", "v"),
    "splice_stats": lambda s, d: _R(C.splice_stats(*_old_new(s, d), K), "key", "n", "mean_diff", "max_diff"),
    "correlations": lambda s, d: _R(C.correlations(signal(s, d), "key"), "a", "b", "r"),
    "salience": lambda s, d: C.salience(_weeks(s, d), "key"),
    "names": lambda s, d: _read(s, d, "part").select("p_partkey", T.slugify(F.col("p_brand")).alias("slug"), T.request_key(F.array("p_brand"), F.lit("us"), F.lit("all")).alias("request")),
    "ar_backtest": lambda s, d: _R(B.rolling(B.pack(target(s, d), None, K), K, B.Plan(models=("ar",))), "key", "model", "origin", "pidx", "y", "base", "p"),
    "search_backtest": lambda s, d: B.rolling(_packed(s, d), K, B.Plan(lags=2, models=("ar", "ols", "ridge", "arlr"))),
    "penalised_backtest": lambda s, d: B.rolling(_packed(s, d), K, B.Plan(models=("lasso", "enet"), chunk=1)),
    "forward": lambda s, d: B.forward(_packed(s, d), K, B.Plan(lags=2, models=("ar", "ridge"))),
    "clusters": lambda s, d: B.clusters(_packed(s, d), K),
    "selections": lambda s, d: B.selections(B.rolling(_packed(s, d), K, B.Plan(models=("arlr",), chunk=8)), K),
    "verdict": _verdicts,
}

_H = """q AS (SELECT key, pidx, y, max(p) FILTER (WHERE model = 'naive') AS f0 FROM c GROUP BY 1, 2, 3), t AS (SELECT c.key, c.model, c.pidx, {loss} AS d FROM c JOIN q USING (key, pidx) WHERE model <> 'naive'),
u AS (SELECT *, d - avg(d) OVER (PARTITION BY key, model) AS e FROM t), l AS (SELECT *, e * lag(e, 1) OVER k AS l1, e * lag(e, 2) OVER k AS l2 FROM u WINDOW k AS (PARTITION BY key, model ORDER BY pidx)),
v AS (SELECT key, model, count(*) AS n, avg(d) AS m, greatest(sum(e * e) / count(*) + 2 * (2 / 3.0) * sum(l1) / count(*) + 2 * (1 / 3.0) * sum(l2) / count(*), 1e-18) / count(*) AS var FROM l GROUP BY 1, 2)"""
_DM = _H.format(loss="(c.y - f0) ** 2 - (c.y - p) ** 2")
_CW = _H.format(loss="(c.y - f0) ** 2 - ((c.y - p) ** 2 - (f0 - p) ** 2)")
_D = "n AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"
_ON = "o AS (SELECT * FROM x WHERE pidx < 23988), n AS (SELECT key, pidx, v + 1 AS v FROM x WHERE pidx >= 23976)"

ORACLE_SQL = {
    "dm_test": f"WITH {_Y}, {_B}, {_DM} SELECT key, model, n, round(CASE WHEN n >= 8 THEN m / sqrt(var) * sqrt((n + 1 - 6 + 6.0 / n) / n) END, 6) AS dm_stat FROM v",
    "cw_test": f"WITH {_Y}, {_B}, {_CW} SELECT key, model, n, round(CASE WHEN n >= 8 THEN m / sqrt(var) END, 6) AS cw_stat FROM v",
    "directions": f"""WITH {_Y}, {_B}, z AS (SELECT key, model, sign(y - base) AS u, sign(round(p - base, 10)) AS s FROM c WHERE y <> base),
g AS (SELECT key, model, count(*) AS n, CAST(sum(CASE WHEN u = s THEN 1 ELSE 0 END) AS BIGINT) AS hits, avg(CASE WHEN u > 0 THEN 1.0 ELSE 0 END) AS base_up FROM z GROUP BY 1, 2)
SELECT key, model, n, hits, round(base_up, 6) AS base_up, round(hits / n, 6) AS rate, round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5))) FROM (SELECT unnest(range(hits, n + 1)) AS k)), 6) AS p_half FROM g""",
    "mase": f"WITH {_Y}, {_B}, h AS (SELECT key, abs(v - lag(v, 12) OVER {_W})) AS a FROM y), e AS (SELECT key, avg(a) AS sc FROM h GROUP BY 1) SELECT key, model, round(avg(abs(y - p)) / max(sc), 6) AS mase FROM c JOIN e USING (key) GROUP BY 1, 2",
    "regime_split": f"WITH {_Y}, {_B}, k AS (SELECT key, median(y) AS med FROM (SELECT DISTINCT key, pidx, y FROM c) GROUP BY 1) SELECT key, model, round(avg(CASE WHEN y >= med THEN abs(y - p) END), 6) AS mae_high, round(avg(CASE WHEN y < med THEN abs(y - p) END), 6) AS mae_low FROM c JOIN k USING (key) GROUP BY 1, 2",
    "season_split": f"WITH {_Y}, {_B}, k AS (SELECT *, (pidx - 1) % 12 + 1 AS mo FROM c) SELECT key, model, round(sqrt(avg((y - p) ** 2) FILTER (WHERE mo >= 10 OR mo <= 3)), 6) AS rmse_cold, round(sqrt(avg((y - p) ** 2) FILTER (WHERE mo BETWEEN 4 AND 9)), 6) AS rmse_warm FROM k GROUP BY 1, 2",
    "error_concentration": f"WITH {_Y}, {_B} SELECT key, model, round(sum(CASE WHEN pidx BETWEEN 23970 AND 23990 THEN (y - p) ** 2 ELSE 0 END) / sum((y - p) ** 2), 6) AS inside FROM c GROUP BY 1, 2",
    "exclusion_window": f"WITH {_Y}, {_B} SELECT key, model, count(*) AS n FROM c WHERE pidx NOT BETWEEN 23970 AND 23990 GROUP BY 1, 2",
    "rolling_coverage": f"""WITH {_Y}, {_B}, a AS (SELECT key, model, abs(y - p) AS e, list(abs(y - p)) OVER (PARTITION BY key, model ORDER BY pidx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS h FROM c)
SELECT key, model, count(*) AS n, round(avg(CASE WHEN e <= list_sort(h)[23] THEN 1.0 ELSE 0 END), 6) AS coverage FROM a WHERE len(h) = 24 GROUP BY 1, 2""",
    "rank_correlation": f"""WITH {_Y}, {_B}, r AS (SELECT *, rank() OVER (PARTITION BY key, model ORDER BY y) + (count(*) OVER (PARTITION BY key, model, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY key, model ORDER BY p) + (count(*) OVER (PARTITION BY key, model, p) - 1) / 2.0 AS rp FROM c)
SELECT key, model, count(*) AS n, round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY 1, 2""",
    "derive_pct": f"WITH {_X}, k AS (SELECT key, pidx, (v / lag(v) OVER {_W}) - 1) * 100 AS v FROM x) SELECT key, pidx, round(v, 6) AS v FROM k WHERE v IS NOT NULL",
    "derive_logdiff": f"WITH {_X}, k AS (SELECT key, pidx, (ln(v) - ln(lag(v) OVER {_W}))) * 100 AS v FROM x) SELECT key, pidx, round(v, 6) AS v FROM k WHERE v IS NOT NULL",
    "fourier": f"WITH {_Y} SELECT key, pidx, round(sin(pidx * pi() / 6), 6) AS sin1, round(cos(pidx * pi() / 6), 6) AS cos1, round(sin(pidx * pi() / 3), 6) AS sin2, round(cos(pidx * pi() / 3), 6) AS cos2 FROM y",
    "normalise": f"WITH {_Y} SELECT key, pidx, round(100 * v / max(v) OVER (PARTITION BY key)) AS v FROM y",
    "asof_lags": f"""WITH {_D}, lo AS (SELECT DISTINCT key, last_day(ds) AS ds FROM n), j AS (SELECT lo.key, lo.ds, n.v, row_number() OVER (PARTITION BY lo.key, lo.ds ORDER BY n.ds DESC) AS r FROM lo JOIN n ON n.key = lo.key AND n.ds <= lo.ds)
SELECT key, ds, round(sum(v * exp(0.1 * (r - 1) - 0.2 * (r - 1) * (r - 1))) / {sum(WEIGHTS)!r}, 6) AS v FROM j WHERE r <= 4 GROUP BY 1, 2 HAVING count(*) = 4""",
    "anchored": f"""WITH {_X}, w AS (SELECT key AS keyword, pidx, v, CAST(floor(CAST(substr(key, 7, 2) AS INT) / 4) AS INT) AS b FROM x), a AS (SELECT avg(v) AS m FROM w WHERE keyword = 'Brand#11')
SELECT keyword, pidx, round(CASE WHEN keyword = 'Brand#11' THEN v ELSE v / (1 + b) * (SELECT m FROM a) / ((SELECT m FROM a) / (1 + b)) END, 6) AS v FROM w""",
    "splice": f"WITH {_X}, {_ON} SELECT o.key, o.pidx, o.v FROM o LEFT JOIN (SELECT key, min(pidx) AS s FROM n GROUP BY 1) USING (key) WHERE s IS NULL OR o.pidx < s UNION ALL SELECT * FROM n",
    "splice_stats": f"WITH {_X}, {_ON} SELECT o.key, count(*) AS n, round(avg(n.v - o.v), 6) AS mean_diff, round(max(abs(n.v - o.v)), 6) AS max_diff FROM o JOIN n ON o.key = n.key AND o.pidx = n.pidx GROUP BY 1",
    "correlations": f"WITH {_X} SELECT a.key AS a, b.key AS b, round(corr(a.v, b.v), 6) AS r FROM x a JOIN x b ON a.pidx = b.pidx AND a.key < b.key GROUP BY 1, 2",
    "salience": """WITH w AS (SELECT event_type AS key, date_trunc('week', ts) AS wk, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY wk) AS share FROM w),
t AS (SELECT wk, sum(v) AS t, row_number() OVER (ORDER BY wk DESC) AS b FROM w GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN b <= 4 THEN t END DESC NULLS LAST, wk) AS k, least(max(b) OVER (), 8) AS n FROM t WHERE b <= 8)
SELECT key, round(avg(share) FILTER (WHERE b <= 4), 3) AS last4, round(avg(share) FILTER (WHERE b > n - 4), 3) AS prev4, round(avg(share) FILTER (WHERE b <= 4 AND k > 1), 3) AS ex_spike FROM s JOIN k USING (wk) GROUP BY 1""",
    "names": "SELECT p_partkey, replace(lower(p_brand), '#', '-') AS slug, sha1('{\"cat\": 0, \"geo\": \"US\", \"gprop\": \"\", \"keywords\": [\"' || p_brand || '\"], \"timeframe\": \"all\"}')[1:10] AS request FROM part",
    "ar_backtest": f"""WITH {_Y}, i AS (SELECT *, row_number() OVER {_W}) - 1 AS i, lead(v) OVER {_W}) AS t, lead(pidx) OVER {_W}) AS tp FROM y),
f AS (SELECT *, regr_slope(t, v) OVER w AS s, regr_intercept(t, v) OVER w AS c FROM i WINDOW w AS {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, 'ar' AS model, pidx AS origin, tp AS pidx, t AS y, v AS base, round(c + s * v, 6) AS p FROM f WHERE i >= 24 AND t IS NOT NULL""",
}
