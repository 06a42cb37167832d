"""Rolling-origin backtests and forward forecasts.

A series is packed into one row of arrays: it holds one value per calendar period, so its length is the calendar's, never
the number of raw rows. Rows are then dealt by (series, model, chunk of origins), so that long backtests of one series
use many tasks, and each Arrow batch fits its windows in numpy. Nothing is gathered on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from augury.operators import arima as A
from augury.operators import models as M
from augury.operators.preprocess import prepare


@dataclass(frozen=True)
class Plan:
    """What a backtest fits. ``known``: the value of the origin's own period is out by then. ``order`` and ``seasonal`` are those of
    the models "arima" (the target's own past) and "arimax" (the signals too)."""

    horizon: int = 1
    lags: int = 1
    x_lags: int = 0
    period: int = 12
    harmonics: int = 0
    known: bool = True
    window: int | None = None
    min_train: int = 24
    step: int = 1
    max_origins: int | None = None
    diff: bool = False
    prep: str = "raw"
    chunk: int = 32
    order: tuple[int, int, int] = (1, 0, 0)
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 0)
    models: tuple[str, ...] = field(default=("ar", "ols", "ridge"))


def pack(y: DataFrame, x: DataFrame | None, keys: list[str]) -> DataFrame:
    """(keys, pidx, y arrays in period order; names and xs of signals as one array per period).

    ``x`` has keys, keyword, pidx, v; a signal without a value in some period of the target counts as zero there, which the
    repair of zeros then mends like any other. ``y`` may end in periods without a value (see ``extend``): only forward
    forecasts look at those, and only where a signal has them."""
    one = y.select(*keys, "pidx", F.col("v").cast("double").alias("y"))
    if x is not None:
        names = x.groupBy(*keys).agg(F.array_sort(F.collect_set("keyword")).alias("names"))
        values = x.groupBy(*keys, "pidx").agg(F.map_from_entries(F.collect_list(F.struct("keyword", F.col("v").cast("double")))).alias("m"))
        one = one.join(values, [*keys, "pidx"], "left").join(names, keys, "left")
        row = F.transform("names", lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0.0)))
        one = one.withColumn("xs", F.coalesce(row, F.array().cast("array<double>")))
    else:
        one = one.withColumns({"names": F.array().cast("array<string>"), "xs": F.array().cast("array<double>")})
    g = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pidx", "y", "xs"))).alias("a"), F.first("names", True).alias("names"))
    return g.select(*keys, "names", *[F.col("a")[c].alias(c) for c in ("pidx", "y", "xs")])


def design_rows(y: np.ndarray, X: np.ndarray, pidx: np.ndarray, plan: Plan, search: bool) -> np.ndarray:
    """One row of features per origin; nan where a lag is missing."""
    n, h = len(y), plan.horizon
    start = 0 if plan.known and h >= 1 else 1
    v = np.concatenate([[np.nan], np.diff(y)]) if plan.diff else y
    back = lambda a, j: np.concatenate([np.full(j, np.nan), a[: n - j]]) if j < n else np.full(n, np.nan)
    cols = [back(v, start + j) for j in range(plan.lags)]
    if search:
        cols += [back(X[:, k], j) for k in range(X.shape[1]) for j in range(plan.x_lags + 1)]
    for j in range(1, plan.harmonics + 1):
        angle = 2 * np.pi * j * (pidx + h) / plan.period
        cols += [np.sin(angle), np.cos(angle)]
    return np.column_stack(cols)


def arima_at(t: int, y: np.ndarray, X: np.ndarray, names: list[str], plan: Plan, search: bool) -> float | None:
    """The forecast of y[t + horizon] at row t by ARIMA errors; a target's signals are those of ``horizon`` periods before it."""
    h, known = plan.horizon, plan.known and plan.horizon >= 1
    lo = 0 if plan.window is None else max(0, t + 1 - plan.window)
    end = t + 1 if known else t
    if search and X.shape[1]:
        Xw, _ = prepare(X[lo : t + 1], names, plan.prep, plan.period)
        own, Xw, ahead = y[lo + h : end], Xw[: max(end - lo - h, 0)], Xw[max(end - lo - h, 0) :]
    else:
        own = y[lo:end]
        Xw, ahead = np.zeros((len(own), 0)), np.zeros((t + 1 + h - end, 0))
    if len(own) < A.needed(Xw.shape[1], plan.order, plan.seasonal) or np.isnan(own).any():
        return None
    return A.forecast(A.fit(own, Xw, plan.order, plan.seasonal), own, Xw, ahead, plan.order, plan.seasonal)


def forecast_at(t: int, y: np.ndarray, X: np.ndarray, names: list[str], pidx: np.ndarray, plan: Plan, model: str) -> tuple[float, dict[str, float]] | None:
    """The forecast of y[t + horizon] made at row t, and the largest coefficient of each signal (none for "rf", "arima" and
    "arimax"); None where too few rows train it.

    Only rows up to t are looked at, and the target's own value at t only where it is known by then."""
    if model in ("arima", "arimax"):
        p = arima_at(t, y, X, names, plan, model == "arimax")
        return None if p is None else (p, {})
    h, search = plan.horizon, model != "ar"
    known = plan.known and h >= 1
    lo = 0 if plan.window is None else max(0, t + 1 - plan.window)
    yw, Xw = y[lo : t + 1].copy(), X[lo : t + 1]
    if not known:
        yw[-1] = np.nan
    if search and Xw.shape[1]:
        Xw, names = prepare(Xw, names, plan.prep, plan.period)
    rows = design_rows(yw, Xw, pidx[lo : t + 1], plan, search)
    base = yw if known else np.concatenate([[np.nan], yw[:-1]])
    target = np.concatenate([yw[h:], np.full(min(h, len(yw)), np.nan)])[: len(yw)]
    if plan.diff:
        target = target - base
    ok = ~np.isnan(rows).any(1) & ~np.isnan(target)
    least = max(8, rows.shape[1] // 2) if model in ("ar", "ols") else 8
    if ok.sum() < least or np.isnan(rows[-1]).any():
        return None
    level = base[-1] if plan.diff else 0.0
    if model == "rf":
        return M.forest(rows[ok], target[ok], rows[-1]) + level, {}
    coef = M.fitter(model, plan.lags)(rows[ok], target[ok])
    used = coef[1 + plan.lags : 1 + plan.lags + len(names) * (plan.x_lags + 1)].reshape(-1, plan.x_lags + 1) if search else np.zeros((0, 1))
    weight = {n: float(c[np.abs(c).argmax()]) for n, c in zip(names, used)}
    return float(coef[0] + rows[-1] @ coef[1:] + level), weight


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.asarray(row.y, float)
    X = np.array([list(x) for x in row.xs], float).reshape(len(y), -1)
    return y, X, np.asarray(row.pidx, np.int64)


def _schema(packed: DataFrame, keys: list[str], ddl: str) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in packed.schema if f.name in keys] + _parse_datatype_string(ddl).fields)


def rolling(packed: DataFrame, keys: list[str], plan: Plan) -> DataFrame:
    """(keys, model, origin, pidx of the target, y, base, p, chosen): one row per origin that could be fitted.

    ``chosen`` names the signals with a coefficient. Series that are shorter than ``min_train`` + horizon give no rows."""
    last = F.size("y") - plan.horizon - 1
    first = F.lit(plan.min_train)
    at = F.when(last >= first, F.sequence(first, last, F.lit(plan.step))).otherwise(F.array().cast("array<int>"))
    if plan.max_origins:
        at = F.slice(at, F.greatest(F.size(at) - plan.max_origins + 1, F.lit(1)), plan.max_origins)
    d = packed.withColumn("_at", at).filter(F.size("_at") > 0)
    starts = F.sequence(F.lit(1), F.size("_at"), F.lit(plan.chunk))
    d = d.withColumn("_from", F.explode(starts)).withColumn("model", F.explode(F.array(*[F.lit(m) for m in plan.models])))
    # With a number, since small partitions are otherwise merged into one task, however long their fits.
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("_at", F.slice("_at", F.col("_from"), F.lit(plan.chunk))).repartition(n, *keys, "model", "_from")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                y, X, pidx = _arrays(row)
                names = list(row.names) if row.names is not None else []
                for t in row[where]:
                    got = forecast_at(int(t), y, X, names, pidx, plan, row.model)
                    if got is None:
                        continue
                    p, weight = got
                    chosen = [n for n, c in weight.items() if abs(c) > 1e-8]
                    base = y[t] if plan.horizon >= 1 else y[t - 1]
                    out.append((*[getattr(row, k) for k in keys], row.model, pidx[t], pidx[t + plan.horizon], y[t + plan.horizon], base, p, chosen))
            yield pd.DataFrame(out, columns=[*keys, "model", "origin", "pidx", "y", "base", "p", "chosen"])

    where = d.columns.index("_at")
    return d.mapInPandas(run, _schema(packed, keys, "model string, origin long, pidx long, y double, base double, p double, chosen array<string>"))


def leakage(y: DataFrame, x: DataFrame, keys: list[str], plan: Plan, late: int = 1) -> DataFrame:
    """``rolling`` on the target as it is (alignment "own") and on the target labelled ``late`` periods late ("late"), where each value
    stands beside signals of periods after it. Much smaller errors of the latter show what a wrong label would have leaked."""
    both = y.withColumn("alignment", F.explode(F.array(F.lit("own"), F.lit("late"))))
    both = both.withColumn("pidx", F.col("pidx") + F.when(F.col("alignment") == "late", late).otherwise(0))
    return rolling(pack(both, x.withColumn("alignment", F.explode(F.array(F.lit("own"), F.lit("late")))), [*keys, "alignment"]), [*keys, "alignment"], plan)


def forward(packed: DataFrame, keys: list[str], plan: Plan, top: int = 12) -> DataFrame:
    """(keys, model, origin, pidx, p, features, nowcast): the forecast after each series' last known value.

    The origin is the last period with a value. A horizon of 0 has the period after it as its origin, where the signals reach
    that far; where they do not, the forecast is the one a period ahead, and ``nowcast`` is false. ``features`` names the
    ``top`` signals by size of coefficient."""
    d = packed.withColumn("model", F.explode(F.array(*[F.lit(m) for m in plan.models]))).repartition(*keys, "model")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                y, X, pidx = _arrays(row)
                t = int(np.flatnonzero(~np.isnan(y))[-1]) if (~np.isnan(y)).any() else -1
                if t < 0:
                    continue
                now = plan.horizon == 0 and len(y) > t + 1
                step = plan if now or plan.horizon else replace(plan, horizon=1, known=True)
                t += now
                got = forecast_at(t, y, X, list(row.names) if row.names is not None else [], pidx, step, row.model)
                if got:
                    names = sorted((n for n, c in got[1].items() if abs(c) > 1e-8), key=lambda n: -abs(got[1][n]))[:top]
                    out.append((*[getattr(row, k) for k in keys], row.model, pidx[t], pidx[t] + step.horizon, got[0], names, now))
            yield pd.DataFrame(out, columns=[*keys, "model", "origin", "pidx", "p", "features", "nowcast"])

    return d.mapInPandas(run, _schema(packed, keys, "model string, origin long, pidx long, p double, features array<string>, nowcast boolean"))


def selections(preds: DataFrame, keys: list[str]) -> DataFrame:
    """How many origins chose each signal."""
    return preds.select(*keys, "model", F.explode("chosen").alias("keyword")).groupBy(*keys, "model", "keyword").agg(F.count("*").alias("n"))


def selection_report(preds: DataFrame, keys: list[str], top: int = 15) -> DataFrame:
    """(keys, model, origins, mean number of signals chosen, share of origins without any, the ``top`` signals by count)."""
    counts = selections(preds, keys).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "model").orderBy(F.desc("n"), "keyword"))).filter(F.col("_r") <= top)
    lists = counts.groupBy(*keys, "model").agg(F.array_sort(F.collect_list(F.struct("_r", "keyword", "n"))).alias("_l"))
    lists = lists.select(*keys, "model", F.transform("_l", lambda x: F.struct(x["keyword"].alias("keyword"), x["n"].alias("n"))).alias("top"))
    own = preds.groupBy(*keys, "model").agg(F.count("*").alias("origins"), F.avg(F.size("chosen")).alias("mean_chosen"), F.avg((F.size("chosen") == 0).cast("double")).alias("empty"))
    return own.join(lists, [*keys, "model"], "left")


def cluster_stability(packed: DataFrame, keys: list[str], first: int, threshold: float = 0.4) -> DataFrame:
    """(keys, keyword, early, late): each signal's cluster on the first ``first`` periods and on all of them."""
    head = packed.withColumns({c: F.slice(c, 1, first) for c in ("pidx", "y", "xs")})
    early = clusters(head, keys, threshold).withColumnRenamed("cluster", "early")
    return early.join(clusters(packed, keys, threshold).withColumnRenamed("cluster", "late"), [*keys, "keyword"])


def clusters(packed: DataFrame, keys: list[str], threshold: float = 0.4) -> DataFrame:
    """(keys, keyword, cluster) of each series' signals (at most some tens) by average linkage."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                names = list(row.names) if row.names is not None else []
                _, X, _ = _arrays(row)
                out += [(*[getattr(row, k) for k in keys], n, c) for n, c in zip(names, M.cluster(X, threshold))] if names else []
            yield pd.DataFrame(out, columns=[*keys, "keyword", "cluster"])

    return packed.mapInPandas(run, _schema(packed, keys, "keyword string, cluster int"))
