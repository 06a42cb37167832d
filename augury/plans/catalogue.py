"""Queries of the series operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from augury.operators import series as S


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def target(spark, d):
    """Monthly order counts per priority: the target series."""
    o = _read(spark, d, "orders").withColumnRenamed("o_orderpriority", "key")
    return S.period_aggregate(o, ["key"], "o_orderdate", F.count("*").cast("double"))


def signal(spark, d):
    """Monthly line counts per brand: the signals."""
    li = _read(spark, d, "lineitem").select("l_partkey", "l_shipdate")
    li = li.join(_read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("key")), F.col("l_partkey") == F.col("p_partkey"))
    return S.period_aggregate(li, ["key"], "l_shipdate", F.count("*").cast("double"))


def gaps(spark, d):
    """Daily event counts per user: days without an event are gaps of their own."""
    e = _read(spark, d, "events").withColumnRenamed("user_id", "key")
    return S.period_aggregate(e, ["key"], "ts", F.count("*").cast("double"), "day")


K = ["key"]
_R = lambda df, *c: df.select(*[F.round(x, 6).alias(x) if t == "double" else x for x, t in df.dtypes if x in c])


def _out(df):
    return _R(df, "key", "pidx", "v")


QUERIES = {
    "period_aggregate": lambda s, d: _out(target(s, d)),
    "signal_join": lambda s, d: _out(signal(s, d)),
    "align": lambda s, d: target(s, d).select("key", "pidx", F.col("v").alias("y")).join(signal(s, d).groupBy("pidx").agg(F.sum("v").alias("x")), "pidx").select("key", "pidx", "y", "x"),
    "gap_fill": lambda s, d: S.fill_calendar(gaps(s, d), K).select("key", "pidx", "v"),
    "interpolate": lambda s, d: _out(S.interpolate(S.fill_calendar(gaps(s, d), K), K)),
    "missing_periods": lambda s, d: (lambda g: S.fill_calendar(g, K).join(g, ["key", "pidx"], "left_anti").select("key", "pidx"))(gaps(s, d)),
    "zero_filter": lambda s, d: _out(S.zero_filter(signal(s, d).withColumn("v", F.expr("case when pidx % 2 = 0 or key < 'Brand#3' then v else 0 end")), "key", 0.6)),
    "zero_repair": lambda s, d: _out(S.zero_repair(signal(s, d).withColumn("v", F.expr("case when pidx % 3 = 0 then 0 else v end")), K)),
    "log1p": lambda s, d: _out(signal(s, d).withColumn("v", F.log1p("v"))),
    "smooth": lambda s, d: _out(S.smooth(signal(s, d), K, 2.0)),
    "detrend_rolling": lambda s, d: _out(S.detrend(signal(s, d), K, "rolling", 12)),
    "detrend_linear": lambda s, d: _out(S.detrend(signal(s, d), K, "linear")),
    "detrend_diff": lambda s, d: _out(S.detrend(signal(s, d), K, "diff")),
    "deseasonalize": lambda s, d: _out(S.deseasonalize(signal(s, d), K)),
    "standardize": lambda s, d: _out(S.standardize(signal(s, d), K)),
    "design": lambda s, d: S.design(target(s, d), K, 3, 2).select("key", "pidx", "v", "lag1", "lag2", "lag3", "target"),
    "benchmarks": lambda s, d: _R(S.benchmarks(target(s, d), K), "key", "pidx", "model", "y", "p"),
    "backtest_metrics": lambda s, d: _R(S.metrics(S.common_sample(S.benchmarks(target(s, d), K), K), K), "key", "model", "n", "mae", "rmse", "mape", "oos_r2", "diracc"),
    "conformal": lambda s, d: _R(S.conformal(S.common_sample(S.benchmarks(target(s, d), K), K), K), "key", "model", "n", "half"),
    "shares": lambda s, d: _R(S.shares(target(s, d), "key"), "key", "pidx", "share"),
    "stitch": lambda s, d: _out(S.stitch(signal(s, d).filter("pidx < 23988").withColumn("v", F.col("v") * 3), signal(s, d).filter("pidx >= 23976"), "key")),
    "leader": lambda s, d: target(s, d).groupBy("pidx").agg(F.min_by("key", F.struct(-F.col("v"), "key")).alias("leader"), F.max("v").alias("v")),
    "vintage_dispersion": lambda s, d: _R(_read(s, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y"), "l_linenumber").agg(F.sum("l_quantity").alias("q")).groupBy("l_returnflag", "y").agg(F.avg("q").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("q")).alias("sd")), "l_returnflag", "y", "mean", "sd"),
}

_Y = "y AS (SELECT o_orderpriority AS key, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS pidx, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"
_X = "x AS (SELECT p_brand AS key, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS pidx, CAST(count(*) AS DOUBLE) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
_G = """g AS (SELECT user_id AS key, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS pidx, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
f AS (SELECT c.key, c.pidx, g.v FROM (SELECT key, unnest(range(min(pidx), max(pidx) + 1)) AS pidx FROM g GROUP BY key) c LEFT JOIN g ON g.key = c.key AND g.pidx = c.pidx)"""
_W = "(PARTITION BY key ORDER BY pidx"
_B = f"""s AS (SELECT *, v - lag(v) OVER {_W}) AS d FROM y), m AS (SELECT *, avg(d) OVER {_W} ROWS UNBOUNDED PRECEDING) AS md FROM s),
w AS (SELECT key, pidx, v AS y, lag(v) OVER {_W}) AS base, lag(v, 12) OVER {_W}) AS sea, lag(v) OVER {_W}) + lag(md) OVER {_W}) AS dri FROM m),
b AS (SELECT key, pidx, 'naive' AS model, y, base, base AS p FROM w WHERE base IS NOT NULL UNION ALL SELECT key, pidx, 'seasonal', y, base, sea FROM w WHERE sea IS NOT NULL UNION ALL SELECT key, pidx, 'drift', y, base, dri FROM w WHERE dri IS NOT NULL),
c AS (SELECT * FROM b WHERE (key, pidx) IN (SELECT (key, pidx) FROM b GROUP BY key, pidx HAVING count(*) = 3))"""

ORACLE_SQL = {
    "period_aggregate": f"WITH {_Y} SELECT key, pidx, v FROM y",
    "signal_join": f"WITH {_X} SELECT key, pidx, v FROM x",
    "align": f"WITH {_Y}, {_X}, t AS (SELECT pidx, sum(v) AS x FROM x GROUP BY 1) SELECT key, y.pidx, v AS y, t.x FROM y JOIN t ON y.pidx = t.pidx",
    "gap_fill": f"WITH {_G} SELECT key, pidx, v FROM f",
    "missing_periods": f"WITH {_G} SELECT key, pidx FROM f WHERE v IS NULL",
    "interpolate": f"""WITH {_G}, h AS (SELECT *, last_value(v IGNORE NULLS) OVER {_W}) AS a, last_value(CASE WHEN v IS NOT NULL THEN pidx END IGNORE NULLS) OVER {_W}) AS p,
first_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, first_value(CASE WHEN v IS NOT NULL THEN pidx END IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM f)
SELECT key, pidx, round(CASE WHEN v IS NOT NULL THEN v ELSE a + (b - a) * (pidx - p) / (n - p) END, 6) AS v FROM h WHERE v IS NOT NULL OR pidx - p <= 3""",
    "zero_filter": f"WITH {_X}, z AS (SELECT key, pidx, CASE WHEN pidx % 2 = 0 OR key < 'Brand#3' THEN v ELSE 0 END AS v FROM x) SELECT * FROM z WHERE key IN (SELECT key FROM z GROUP BY key HAVING avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) >= 0.6)",
    "zero_repair": f"WITH {_X}, z AS (SELECT key, pidx, CASE WHEN pidx % 3 <> 0 AND v > 0 THEN v END AS v FROM x) SELECT key, pidx, coalesce(last_value(v IGNORE NULLS) OVER {_W}), first_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM z",
    "log1p": f"WITH {_X} SELECT key, pidx, round(ln(1 + v), 6) AS v FROM x",
    "smooth": f"WITH {_X}, i AS (SELECT *, row_number() OVER {_W}) AS i FROM x) SELECT key, pidx, round(sum(v * pow(2, i / 2.0)) OVER {_W}) / sum(pow(2, i / 2.0)) OVER {_W}), 6) AS v FROM i",
    "detrend_rolling": f"WITH {_X}, r AS (SELECT key, pidx, v - CASE WHEN count(v) OVER p >= 3 THEN avg(v) OVER p END AS v FROM x WINDOW p AS {_W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT key, pidx, round(coalesce(v, first_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM r",
    "detrend_linear": f"WITH {_X}, l AS (SELECT key, regr_slope(v, pidx) AS a, regr_intercept(v, pidx) AS b FROM x GROUP BY key) SELECT key, pidx, round(v - b - a * pidx, 6) AS v FROM x JOIN l USING (key)",
    "detrend_diff": f"WITH {_X}, r AS (SELECT key, pidx, v - lag(v) OVER {_W}) AS v FROM x) SELECT key, pidx, coalesce(v, first_value(v IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM r",
    "deseasonalize": f"WITH {_X} SELECT key, pidx, round(v - avg(v) OVER (PARTITION BY key, pidx % 12) + avg(v) OVER (PARTITION BY key), 6) AS v FROM x",
    "standardize": f"WITH {_X} SELECT key, pidx, round((v - avg(v) OVER k) / CASE WHEN stddev_pop(v) OVER k = 0 THEN 1 ELSE stddev_pop(v) OVER k END, 6) AS v FROM x WINDOW k AS (PARTITION BY key)",
    "design": f"WITH {_Y}, r AS (SELECT key, pidx, v, lag(v, 1) OVER {_W}) AS lag1, lag(v, 2) OVER {_W}) AS lag2, lag(v, 3) OVER {_W}) AS lag3, lead(v, 2) OVER {_W}) AS target FROM y) SELECT * FROM r WHERE lag3 IS NOT NULL AND target IS NOT NULL",
    "benchmarks": f"WITH {_Y}, {_B} SELECT key, pidx, model, y, round(p, 6) AS p FROM b",
    "backtest_metrics": f"""WITH {_Y}, {_B} SELECT key, model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs((y - p) / y) * 100), 6) AS mape,
round(1 - sum((y - p) * (y - p)) / sum((y - base) * (y - base)), 6) AS oos_r2, CASE WHEN max(abs(round(p - base, 10))) > 0 THEN round(avg(CASE WHEN y <> base THEN CASE WHEN sign(y - base) = sign(round(p - base, 10)) THEN 1.0 ELSE 0.0 END END), 6) END AS diracc FROM c GROUP BY 1, 2""",
    "conformal": f"""WITH {_Y}, {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY key, model ORDER BY pidx DESC) AS r FROM c), a AS (SELECT key, model, count(*) AS n, list_sort(list(abs(y - p))) AS e FROM r WHERE r <= 36 GROUP BY 1, 2)
SELECT key, model, n, round(e[least(greatest(CAST(ceil(0.9 * (n + 1)) AS BIGINT) - 1, 0), n - 1) + 1], 6) AS half FROM a""",
    "shares": f"WITH {_Y} SELECT key, pidx, round(v / sum(v) OVER (PARTITION BY pidx), 6) AS share FROM y",
    "stitch": f"""WITH {_X}, o AS (SELECT key, pidx, v * 3 AS v FROM x WHERE pidx < 23988), n AS (SELECT * FROM x WHERE pidx >= 23976),
r AS (SELECT o.key, avg(n.v) / avg(o.v) AS r FROM o JOIN n ON o.key = n.key AND o.pidx = n.pidx GROUP BY 1), f AS (SELECT key, min(pidx) AS st FROM n GROUP BY 1)
SELECT o.key, o.pidx, round(o.v * coalesce(r, 1), 6) AS v FROM o JOIN f USING (key) LEFT JOIN r USING (key) WHERE o.pidx < st UNION ALL SELECT key, pidx, v FROM n""",
    "leader": f"WITH {_Y}, r AS (SELECT *, row_number() OVER (PARTITION BY pidx ORDER BY v DESC, key) AS r FROM y) SELECT pidx, key AS leader, v FROM r WHERE r = 1",
    "vintage_dispersion": "WITH q AS (SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS y, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3) SELECT l_returnflag, y, round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS sd FROM q GROUP BY 1, 2",
}
