"""Operators on long tables of series: (key columns, pidx, v). Every window is per series, so series spread over executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(keys, order="pidx"):
    return Window.partitionBy(*keys).orderBy(order)


def period_aggregate(df: DataFrame, keys: list[str], ts: str, value: Column, unit: str = "month") -> DataFrame:
    """Tumbling periods with ``v`` and ``pidx``, the count of periods since 1970."""
    start = F.date_trunc(unit, ts).cast("date")
    pidx = (F.year("ds") * 12 + F.month("ds")) if unit == "month" else F.datediff("ds", F.lit("1970-01-01")) / (7 if unit == "week" else 1)
    return df.groupBy(*keys, start.alias("ds")).agg(value.alias("v")).withColumn("pidx", F.floor(pidx).cast("long"))


def fill_calendar(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the missing periods of each series with a null value."""
    span = df.groupBy(*keys).agg(F.min("pidx").alias("lo"), F.max("pidx").alias("hi"))
    full = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("pidx"))
    return full.join(df.select(*keys, "pidx", "v"), [*keys, "pidx"], "left")


def interpolate(df: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Linear between known values, for the first ``limit`` periods of a gap; what is still null goes."""
    back = _w(keys).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _w(keys).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.col("pidx"))
    d = df.withColumns({
        "_p": F.last(known, True).over(back), "_n": F.first(known, True).over(ahead),
        "_a": F.last("v", True).over(back), "_b": F.first("v", True).over(ahead),
    })
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("pidx") - F.col("_p")) / (F.col("_n") - F.col("_p"))
    v = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("pidx") - F.col("_p") <= limit, line)
    return d.withColumn("v", v).filter("v is not null").drop("_p", "_n", "_a", "_b")


def zero_filter(df: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Series whose share of values over zero reaches ``least``."""
    share = df.groupBy(key).agg(F.avg((F.coalesce("v", F.lit(0.0)) > 0).cast("double")).alias("share"))
    return df.join(share.filter(F.col("share") >= least).select(key), key, "left_semi")


def zero_repair(df: DataFrame, keys: list[str]) -> DataFrame:
    """Zeros become the last value over zero, or else the next."""
    back = _w(keys).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _w(keys).rowsBetween(0, Window.unboundedFollowing)
    live = F.when(F.col("v") > 0, F.col("v"))
    return df.withColumn("v", F.coalesce(F.last(live, True).over(back), F.first(live, True).over(ahead)))


def back(c: str, j: int, keys) -> Column:
    """The value of ``c`` exactly ``j`` periods earlier (later where negative); null where the calendar has a gap there."""
    w = _w(keys)
    return F.when(F.col("pidx") - F.lag("pidx", j).over(w) == j, F.lag(c, j).over(w)) if j else F.col(c)


def assert_contiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; fails when a series lacks a period or has a null value."""
    step = F.col("pidx") - F.lag("pidx").over(_w(keys))
    ok = F.coalesce(step == 1, F.lit(True)) & F.col("v").isNotNull()
    return df.withColumn("_ok", ok).filter(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.lit("a series has a gap or a null")).cast("boolean"))).drop("_ok")


def smooth(df: DataFrame, keys: list[str], halflife: float = 2.0) -> DataFrame:
    """Exponentially weighted mean of all values so far, weights normalised. A null value weighs nothing and takes the last
    mean; it still counts as a period for the decay.

    Weights grow inside blocks of 500 half-lives, so that they stay in range, and a block starts with the sums of the one
    before. What is older weighs under 2^-500, nothing in a double."""
    if halflife <= 0:
        return df
    length = max(int(500 * halflife), 1)
    d = df.withColumn("_i", F.row_number().over(_w(keys)) - 1)
    d = d.withColumn("_b", F.floor(F.col("_i") / length)).withColumn("_g", F.when(F.col("v").isNotNull(), F.pow(F.lit(2.0), (F.col("_i") - F.col("_b") * length) / halflife)))
    inside = Window.partitionBy(*keys, "_b").orderBy("pidx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
    total = lambda x: F.coalesce(F.sum(x).over(inside), F.lit(0.0)) + F.coalesce(F.sum(x).over(before), F.lit(0.0)) * 2.0 ** (-length / halflife)
    d = d.withColumns({"_n": total(F.col("v") * F.col("_g")), "_d": total(F.col("_g"))})
    mean = F.when(F.col("v").isNotNull(), F.col("_n") / F.col("_d"))
    return d.withColumn("_m", mean).withColumn("v", F.last("_m", True).over(_w(keys).rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_b", "_g", "_n", "_d", "_m")


def detrend(df: DataFrame, keys: list[str], method: str = "rolling", window: int = 12) -> DataFrame:
    w = _w(keys)
    if method == "rolling":
        past = w.rowsBetween(-window, -1)
        mean = F.when(F.count("v").over(past) >= max(2, window // 4), F.avg("v").over(past))
        out = df.withColumn("v", F.col("v") - mean)
    elif method == "diff":
        out = df.withColumn("v", F.col("v") - F.lag("v").over(w))
    elif method == "linear":
        whole = Window.partitionBy(*keys)
        line = F.regr_intercept("v", "pidx").over(whole) + F.regr_slope("v", "pidx").over(whole) * F.col("pidx")
        return df.withColumn("v", F.col("v") - F.when(F.count("v").over(whole) >= 3, line).otherwise(F.avg("v").over(whole)))
    else:
        return df
    return out.withColumn("v", F.coalesce("v", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def deseasonalize(df: DataFrame, keys: list[str], period: int = 12) -> DataFrame:
    """Less the mean of the season's position, plus the grand mean."""
    at = Window.partitionBy(*keys, F.pmod("pidx", F.lit(period)))
    return df.withColumn("v", F.col("v") - F.avg("v").over(at) + F.avg("v").over(Window.partitionBy(*keys)))


def standardize(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop("v").over(w)
    return df.withColumn("v", (F.col("v") - F.avg("v").over(w)) / F.when(sd == 0, 1.0).otherwise(sd))


def change(df: DataFrame, keys: list[str], steps: int = 1) -> DataFrame:
    """Overlapping changes over ``steps`` periods; null without a value that long ago."""
    return df.withColumn("v", F.col("v") - back("v", steps, keys))


def design(df: DataFrame, keys: list[str], lags: int, horizon: int) -> DataFrame:
    """Direct multi-step rows: the target ``horizon`` ahead and ``lags`` past values, for rows that have them all."""
    cols = {f"lag{j}": back("v", j, keys) for j in range(1, lags + 1)} | {"target": back("v", -horizon, keys)}
    return df.withColumns(cols).na.drop(subset=list(cols))


def benchmarks(df: DataFrame, keys: list[str], horizon: int = 1, period: int = 12, known: bool = True) -> DataFrame:
    """(keys, pidx of the target, model, y, base, p) of naive, seasonal naive and drift forecasts.

    The last value known at the origin is the origin's own, or with a publication lag (not ``known``, and always for a
    horizon of 0, the nowcast) the one before. ``base``, from which directions are told, is the value at the origin, for
    a nowcast the one before it. A forecast that would need a missing period is left out."""
    late = horizon + (0 if known and horizon >= 1 else 1)
    mean = F.avg("_d").over(_w(keys).rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_d", F.col("v") - back("v", 1, keys)).withColumn("_m", mean)
    last = back("v", late, keys)
    season = period * max(1, -(-horizon // period))
    d = d.withColumns({"base": back("v", max(horizon, 1), keys), "_n": last, "_s": back("v", season, keys), "_t": last + late * back("_m", late, keys)})
    made = [F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in (("naive", "_n"), ("seasonal", "_s"), ("drift", "_t"))]
    d = d.withColumn("_f", F.explode(F.array(*made)))
    return d.select(*keys, "pidx", "_f.model", F.col("v").alias("y"), "base", "_f.p").filter("p is not null")


def common_sample(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Targets that every model of a series predicts: one aggregate instead of a join per model."""
    n = preds.groupBy(*keys).agg(F.countDistinct("model").alias("_n"))
    full = preds.groupBy(*keys, "pidx").agg(F.countDistinct("model").alias("_c")).join(n, keys).filter("_c = _n")
    return preds.join(full.select(*keys, "pidx"), [*keys, "pidx"], "left_semi")


def metrics(preds: DataFrame, keys: list[str], bench: str = "naive") -> DataFrame:
    """Errors of each model, its skill against the forecasts of ``bench`` on the same targets, and its hit-rate of directions.

    A model that never says a direction has no hit-rate. Null where the benchmark makes no error, or has no forecast."""
    f0 = F.max(F.when(F.col("model") == bench, F.col("p"))).over(Window.partitionBy(*keys, "pidx"))
    e = F.col("y") - F.col("p")
    up, said = F.signum(F.col("y") - F.col("base")), F.signum(F.round(F.col("p") - F.col("base"), 10))
    hit = F.avg(F.when(up != 0, (up == said).cast("double")))
    lost = F.when(F.col("_f0").isNotNull(), e * e)
    return preds.withColumn("_f0", f0).groupBy(*keys, "model").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(F.abs("y") > 1e-12, F.abs(e / F.col("y")) * 100)).alias("mape"),
        (1 - F.try_divide(F.sum(lost), F.sum((F.col("y") - F.col("_f0")) ** 2))).alias("oos_r2"),
        F.when(F.max(F.abs(said)) > 0, hit).alias("diracc"),
    )


def conformal(preds: DataFrame, keys: list[str], recent: int = 36, alpha: float = 0.1) -> DataFrame:
    """Half-width of the interval: the order statistic of the last ``recent`` known absolute errors per model."""
    last = Window.partitionBy(*keys, "model").orderBy(F.desc("pidx"))
    d = preds.withColumn("_e", F.abs(F.col("y") - F.col("p"))).filter("_e is not null").withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= recent)
    g = d.groupBy(*keys, "model").agg(F.array_sort(F.collect_list("_e")).alias("_a"), F.count("*").alias("n"))
    k = F.least(F.greatest(F.ceil((1 - alpha) * (F.col("n") + 1)) - 1, F.lit(0)), F.col("n") - 1)
    return g.select(*keys, "model", "n", F.element_at("_a", (k + 1).cast("int")).alias("half"))


def shares(df: DataFrame, entity: str) -> DataFrame:
    """Each entity's part of the period's total; null where that is zero."""
    return df.withColumn("share", F.try_divide("v", F.sum("v").over(Window.partitionBy("pidx"))))


def share_of_sums(df: DataFrame, entity: str) -> DataFrame:
    """Each entity's part of the sum over all periods: a ratio of sums, where ``shares`` gives one ratio a period."""
    total = df.agg(F.sum("v").alias("_t"))
    return df.groupBy(entity).agg(F.sum("v").alias("v")).crossJoin(F.broadcast(total)).select(entity, F.try_divide("v", "_t").alias("share"))  # one row on the right


def stitch(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """The older window scaled to the newer one by their means, where the older is over zero, and kept before its start."""
    o = older.withColumnRenamed("v", "ov").join(newer.withColumnRenamed("v", "nv"), [key, "pidx"])
    live = lambda c: F.avg(F.when(F.col("ov") > 0, F.col(c)))
    ratio = o.groupBy(key).agg(F.when(live("nv") > 0, live("nv") / live("ov")).alias("r"))
    first = newer.groupBy(key).agg(F.min("pidx").alias("start"))
    old = older.join(first, key).filter("pidx < start").join(ratio, key, "left")
    return old.select(key, "pidx", (F.col("v") * F.coalesce("r", F.lit(1.0))).alias("v")).unionByName(newer.select(key, "pidx", "v"))


def stitch_scales(windows: DataFrame, key: str) -> DataFrame:
    """(key, window, n, corr, scale) of overlapping windows numbered from the oldest; the newest keeps its scale.

    ``windows`` has key, window, pidx, v. Each window is brought to the next newer one by their means where the older is over
    zero, and further by that one's own scale. A window without a usable overlap keeps the newer one's scale."""
    newer = windows.select(key, (F.col("window") - 1).alias("window"), "pidx", F.col("v").alias("nv"))
    both = windows.join(newer, [key, "window", "pidx"])
    live = lambda c: F.avg(F.when(F.col("v") > 0, F.col(c)))
    pair = both.groupBy(key, "window").agg(F.count("*").alias("n"), F.corr("v", "nv").alias("corr"), F.when(live("nv") > 0, live("nv") / live("v")).alias("r"))
    each = windows.select(key, "window").distinct().join(pair, [key, "window"], "left")
    chain = Window.partitionBy(key).orderBy(F.desc("window"))
    scale = F.exp(F.sum(F.ln(F.coalesce("r", F.lit(1.0)))).over(chain))
    return each.select(key, "window", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 3, F.col("corr")).alias("corr"), scale.alias("scale"))


def stitch_many(windows: DataFrame, key: str) -> DataFrame:
    """One series a key from its overlapping windows: in each period the newest window that has it, on the newest scale."""
    scaled = windows.join(stitch_scales(windows, key).select(key, "window", "scale"), [key, "window"])
    return scaled.groupBy(key, "pidx").agg(F.max_by(F.col("v") * F.col("scale"), "window").alias("v"))


def chain_means(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """(key, scale, corr): how much larger the newer window is on the overlap, zeros included."""
    o = older.withColumnRenamed("v", "ov").join(newer.withColumnRenamed("v", "nv"), [key, "pidx"])
    return o.groupBy(key).agg(F.try_divide(F.avg("nv"), F.avg("ov")).alias("scale"), F.corr("ov", "nv").alias("corr"))
