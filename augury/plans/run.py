"""One question from its series to a forecast: every horizon's backtests of all models, views, verdicts and the next value.

A spec is a small dict of the driver; the series it names may be as many as there are keys. All tables are DataFrames with
the horizon in ``h``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.operators import backtest as B
from augury.operators import combine as C
from augury.operators import evaluate as E
from augury.operators import series as S
from augury.sources.files import written

#: What a spec holds where it does not say otherwise, by the frequency of its target.
DEFAULTS = {
    "M": {"period": 12, "transform": "diff", "p": 3, "fourier_k": 1, "min_train": 60, "max_origins": 120},
    "W": {"period": 52, "transform": None, "p": 4, "fourier_k": 2, "min_train": 104, "max_origins": 160},
    "D": {"period": 7, "transform": None, "p": 4, "fourier_k": 2, "min_train": 104, "max_origins": 160},
}
ANY = {
    "xlags": 1, "horizons": [{"h": 0, "y_known": False}, {"h": 1, "y_known": True}], "models": ["ridge+raw", "ridge+djorno", "arlr+raw"],
    "windows": [None], "exclude": None, "alpha": 0.1, "clip_min": None, "log": False,
}
TARGET_ONLY = ["naive", "drift", "seasonal", "ar"]


def complete(spec: dict) -> dict:
    return ANY | DEFAULTS[spec["freq"].upper()[0]] | spec


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _named(model: str, prep: str | None = None, window: int | None = None) -> str:
    return model if prep is None else f"{model}+{prep}" + (f"@w{window}" if window else "")


def grid(s: dict, h: int, known: bool) -> list[tuple[str, B.Plan]]:
    """(name, plan) of every fitted model: the target-only one, then each kind and preparation with each window."""
    common = {"horizon": h, "lags": s["p"], "period": s["period"], "harmonics": s["fourier_k"], "known": known, "min_train": s["min_train"],
              "max_origins": s["max_origins"], "diff": s["transform"] == "diff"}
    out = [("ar", B.Plan(models=("ar",), **common))]
    for name in s["models"]:
        kind, prep = name.split("+")
        out += [(_named(kind, prep, w), B.Plan(models=(kind,), prep=prep, window=w, x_lags=s["xlags"], **common)) for w in s["windows"]]
    return out


def target_points(y: DataFrame, keys: list[str], h: int, period: int) -> DataFrame:
    """(keys, model, pidx, p): the next value by the benchmarks that need no fit."""
    steps = max(h, 1)
    d = y.withColumn("_d", F.col("v") - S.back("v", 1, keys))
    last = d.groupBy(*keys).agg(F.max("pidx").alias("end"), F.max_by("v", "pidx").alias("last"), F.avg("_d").alias("mean"))
    season = y.join(last, keys).filter(F.col("pidx") == F.col("end") + steps - period * -(-steps // period)).select(*keys, F.col("v").alias("sea"))
    d = last.join(season, keys, "left")
    made = {"naive": F.col("last"), "drift": F.col("last") + steps * F.col("mean"), "seasonal": F.col("sea")}
    points = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in made.items()]))
    return d.withColumn("_f", points).select(*keys, "_f.model", (F.col("end") + steps).alias("pidx"), "_f.p").filter("p is not null")


def target_only(y: DataFrame, keys: list[str], h: int, period: int, known: bool = True, recent: int = 60, alpha: float = 0.1) -> DataFrame:
    """(keys, bench, pidx, p, half): the benchmark of least error on common targets, its next value and its interval."""
    preds = S.common_sample(S.benchmarks(y, keys, h, period, known), keys)
    bench = E.best_of(S.metrics(preds, keys), keys, ["naive", "drift", "seasonal"])
    half = S.conformal(preds, keys, recent, alpha).select(*keys, F.col("model").alias("bench"), "half")
    points = target_points(y, keys, h, period).withColumnRenamed("model", "bench")
    return points.join(bench, [*keys, "bench"]).join(half, [*keys, "bench"], "left")


def run(y: DataFrame, x: DataFrame, keys: list[str], spec: dict, keep=written) -> dict[str, DataFrame]:
    """Tables ``metrics``, ``verdicts``, ``forecasts`` and ``predictions`` of a spec.

    ``y`` has keys, pidx, v; ``x`` has keys, keyword, pidx, v. Gaps of the target are filled by lines of up to three periods.
    ``keep`` writes a table down, so that the fits, which several tables read, run once and plans stay short."""
    s = complete(spec)
    y = S.assert_contiguous(S.interpolate(S.fill_calendar(y, keys), keys), keys)
    if s["log"]:
        y = y.withColumn("v", F.log("v"))
    y = keep(y, "target")
    packed = keep(B.pack(y, x, keys), "packed")
    ends = y.groupBy(*keys).agg(F.max("pidx").alias("_e"))
    beyond = x.join(ends, keys).filter(F.col("pidx") == F.col("_e") + 1).select(*keys, "pidx", F.lit(None).cast("double").alias("v")).distinct()
    ahead = keep(B.pack(y.select(*keys, "pidx", "v").unionByName(beyond), x, keys), "ahead")
    out: dict[str, list[DataFrame]] = {"metrics": [], "verdicts": [], "forecasts": [], "predictions": []}
    for hz in s["horizons"]:
        h = int(hz["h"])
        known = bool(hz.get("y_known", h >= 1))
        plans = grid(s, h, known)
        search = [n for n, _ in plans if n != "ar"]
        low = (lambda c: F.greatest(c, F.lit(float(s["clip_min"])))) if s["clip_min"] is not None else (lambda c: c)
        fits = [B.rolling(packed, keys, p).select(*keys, "pidx", F.lit(n).alias("model"), "y", "base", (F.col("p") if n == "ar" else low(F.col("p"))).alias("p")) for n, p in plans]
        preds = keep(_union([S.benchmarks(y, keys, h, s["period"], known).select(*keys, "pidx", "model", "y", "base", "p"), *fits]), f"predictions_{h}")
        target = S.common_sample(preds.filter(F.col("model").isin(TARGET_ONLY)), keys)
        bench = E.best_of(S.metrics(target, keys), keys, TARGET_ONLY)
        with_bench = preds.join(F.broadcast(bench), keys)  # one row a series
        table = keep(E.compare(with_bench, keys, F.col("bench"), y, s["period"], h).join(bench, keys), f"metrics_{h}")
        verdict, view = keep(E.verdict(table, keys, search), f"best_{h}"), None
        if s["exclude"]:
            view = keep(E.verdict(E.compare(with_bench, keys, F.col("bench"), y, s["period"], h, tuple(s["exclude"])), keys, search), f"view_{h}")
        both = S.common_sample(with_bench, keys)
        level = y.groupBy(*keys).agg(F.median("v").alias("_med"), F.max_by("v", "pidx").alias("_last"))
        err = F.abs(F.col("y") - F.col("p"))
        now = both.join(level, keys).join(verdict.select(*keys, F.col("model").alias("_best")), keys).filter((F.col("y") > F.col("_med")) == (F.col("_last") > F.col("_med")))
        now = now.groupBy(*keys).agg(F.avg(F.when(F.col("model") == F.col("bench"), err)).alias("bench_mae"), F.avg(F.when(F.col("model") == F.col("_best"), err)).alias("model_mae"))
        verdict = E.confidence(verdict, view, keys, now).join(bench, keys)
        if view is not None:
            verdict = verdict.join(E.in_both_views(verdict, view, keys).select(*keys, "use"), keys)
        verdict = keep(verdict.withColumn("chosen", F.when(F.col("strength") != "none", F.col("model")).otherwise(F.col("bench"))), f"verdicts_{h}")
        points = [target_points(y, keys, h, s["period"]).withColumns({"features": F.array().cast("array<string>"), "nowcast": F.lit(False)})]
        points += [B.forward(ahead, keys, p).select(*keys, F.lit(n).alias("model"), "pidx", (F.col("p") if n == "ar" else low(F.col("p"))).alias("p"), "features", "nowcast") for n, p in plans]
        chosen = verdict.select(*keys, F.col("chosen").alias("model"), "confidence")
        half = S.conformal(preds, keys, 60, s["alpha"]).select(*keys, "model", "half")
        last = y.groupBy(*keys).agg(F.max_by("v", "pidx").alias("last"))
        made = keep(_union(points), f"points_{h}").join(chosen, [*keys, "model"]).join(half, [*keys, "model"], "left").join(E.error_spread(preds, keys), [*keys, "model"], "left").join(last, keys)
        made = made.withColumns({"p": low(F.col("p")), "up": E.up_probability(F.col("p"), F.col("last"), F.col("sd"))})
        made = made.withColumns({"lo": low(F.col("p") - F.col("half")), "hi": F.col("p") + F.col("half"), "lo_unclipped": F.col("p") - F.col("half")})
        if s["log"]:
            made = made.withColumns({c: F.exp(c) for c in ("p", "lo", "hi", "lo_unclipped", "last")})
        for name, df in (("metrics", table), ("verdicts", verdict), ("forecasts", made), ("predictions", preds)):
            out[name].append(df.withColumn("h", F.lit(h)))
    return {name: _union(frames) for name, frames in out.items()} | {"signals": C.signal_info(x, y, "keyword") if len(keys) == 0 else C.signal_info(x, y.groupBy("pidx").agg(F.avg("v").alias("v")), "keyword")}
