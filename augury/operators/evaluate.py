"""Scores and tests of forecasts: (key columns, pidx, model, y, base, p). All models of a target sit in one partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from augury.functions.stats import binomial_upper, normal_upper, t_p
from augury.operators.series import common_sample, conformal, metrics


def exclude(preds: DataFrame, low: int, high: int) -> DataFrame:
    """Without the targets of a window, both ends of it included."""
    return preds.filter(~F.col("pidx").between(low, high))


def paired(preds: DataFrame, keys: list[str], bench: str | Column) -> DataFrame:
    """Each model's forecasts with the benchmark's as ``f0``: a window per target in place of a self-join. ``bench`` is a model
    name or a column that names one for each series."""
    at = Window.partitionBy(*keys, "pidx")
    return preds.withColumn("f0", F.max(F.when(F.col("model") == bench, F.col("p"))).over(at)).filter((F.col("model") != bench) & F.col("f0").isNotNull())


def _mean_test(d: DataFrame, keys: list[str], loss: Column, h: int) -> DataFrame:
    """(keys, n, mean, var): the mean of ``loss`` and its Bartlett variance with h - 1 lags, at least 1e-18 / n."""
    whole = Window.partitionBy(*keys)
    d = d.withColumn("_d", loss).withColumn("_m", F.avg("_d").over(whole)).withColumn("_c", F.col("_d") - F.col("_m"))
    lags = range(1, max(h - 1, 0) + 1)
    d = d.withColumns({f"_l{j}": F.col("_c") * F.lag("_c", j).over(whole.orderBy("pidx")) for j in lags} or {"_l0": F.lit(None)})
    n, top = F.count("*"), max(h - 1, 0) + 1
    var = F.sum(F.col("_c") * F.col("_c")) / n
    for j in lags:
        var = var + 2 * (1 - j / top) * F.coalesce(F.sum(f"_l{j}"), F.lit(0.0)) / n
    return d.groupBy(*keys).agg(n.alias("n"), F.first("_m").alias("mean"), (F.greatest(var, F.lit(1e-18)) / n).alias("var"))


def diebold_mariano(preds: DataFrame, keys: list[str], bench: str | Column, h: int = 1, loss: str = "squared") -> DataFrame:
    """Squared-error (or ``absolute``-error) test against ``bench`` with the small-sample factor; positive favours the model; null under 8 targets."""
    d = paired(preds, keys, bench)
    size = (lambda e: e * e) if loss == "squared" else F.abs
    t = _mean_test(d, [*keys, "model"], size(F.col("y") - F.col("f0")) - size(F.col("y") - F.col("p")), h)
    n = F.col("n")
    stat = F.col("mean") / F.sqrt("var") * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return t.select(*keys, "model", "n", F.when(n >= 8, stat).alias("dm_stat")).withColumn("dm_p", t_p("dm_stat", F.col("n") - 1))


def clark_west(preds: DataFrame, keys: list[str], bench: str | Column, h: int = 1) -> DataFrame:
    """One-sided test of a model that nests ``bench``; null under 8 targets."""
    d = paired(preds, keys, bench)
    y, f0, f1 = F.col("y"), F.col("f0"), F.col("p")
    t = _mean_test(d, [*keys, "model"], (y - f0) ** 2 - ((y - f1) ** 2 - (f0 - f1) ** 2), h)
    return t.select(*keys, "model", "n", F.when(F.col("n") >= 8, F.col("mean") / F.sqrt("var")).alias("cw_stat")).withColumn("cw_p", normal_upper("cw_stat"))


def mase(preds: DataFrame, history: DataFrame, keys: list[str], period: int) -> DataFrame:
    """Mean absolute error over the mean absolute seasonal change of the history."""
    w = Window.partitionBy(*keys).orderBy("pidx")
    scale = history.withColumn("_c", F.abs(F.col("v") - F.lag("v", period).over(w))).groupBy(*keys).agg(F.avg("_c").alias("scale"))
    mae = preds.groupBy(*keys, "model").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return mae.join(scale, keys, "left").select(*keys, "model", F.try_divide("mae", "scale").alias("mase"))


def directions(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Hit-rate of signs where the target moved, its base rate of ups, and binomial tests against a half and the base rate."""
    up, said = F.signum(F.col("y") - F.col("base")), F.signum(F.round(F.col("p") - F.col("base"), 10))
    d = preds.withColumns({"_u": up, "_s": said}).filter("_u <> 0")
    t = d.groupBy(*keys, "model").agg(
        F.count("*").alias("n"), F.sum((F.col("_u") == F.col("_s")).cast("long")).alias("hits"),
        F.avg((F.col("_u") > 0).cast("double")).alias("base_up"), F.avg((F.col("_s") > 0).cast("double")).alias("said_up"),
    )
    rate = F.greatest("base_up", 1 - F.col("base_up"))
    return t.withColumns({"rate": F.col("hits") / F.col("n"), "p_half": binomial_upper("hits", "n", F.lit(0.5)), "p_base": binomial_upper("hits", "n", rate)})


def regimes(preds: DataFrame, keys: list[str], by: str = "level") -> DataFrame:
    """Mean absolute error where the target is at or over its median, and below it; or, by ``change``, where its move from
    ``base`` is over the median move, and not."""
    size = F.col("y") if by == "level" else F.abs(F.col("y") - F.col("base"))
    d = preds.withColumn("_z", size)
    med = d.select(*keys, "pidx", "_z").distinct().groupBy(*keys).agg(F.median("_z").alias("med"))
    e, high = F.abs(F.col("y") - F.col("p")), F.col("_z") >= F.col("med") if by == "level" else F.col("_z") > F.col("med")
    return d.join(med, keys).groupBy(*keys, "model").agg(F.avg(F.when(high, e)).alias("mae_high"), F.avg(F.when(~high, e)).alias("mae_low"))


def seasons(preds: DataFrame, keys: list[str], month: Column) -> DataFrame:
    """Root mean squared error of targets in October to March, and in April to September."""
    e, cold = (F.col("y") - F.col("p")) ** 2, (month >= 10) | (month <= 3)
    return preds.groupBy(*keys, "model").agg(F.sqrt(F.avg(F.when(cold, e))).alias("rmse_cold"), F.sqrt(F.avg(F.when(~cold, e))).alias("rmse_warm"))


def concentration(preds: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Part of the squared error that falls inside a window."""
    e = (F.col("y") - F.col("p")) ** 2
    return preds.groupBy(*keys, "model").agg(F.try_divide(F.sum(F.when(F.col("pidx").between(low, high), e).otherwise(0.0)), F.sum(e)).alias("inside"))


def rolling_coverage(preds: DataFrame, keys: list[str], recent: int = 36, alpha: float = 0.1) -> DataFrame:
    """Share of targets inside the interval of the ``recent`` errors before each; targets without all of those are not counted."""
    w = Window.partitionBy(*keys, "model").orderBy("pidx").rowsBetween(-recent, -1)
    e = F.abs(F.col("y") - F.col("p"))
    d = preds.withColumn("_e", e).withColumn("_a", F.array_sort(F.collect_list("_e").over(w))).filter(F.size("_a") == recent)
    k = min(max(math.ceil((1 - alpha) * (recent + 1)) - 1, 0), recent - 1)
    return d.groupBy(*keys, "model").agg(F.count("*").alias("n"), F.avg((F.col("_e") <= F.element_at("_a", k + 1)).cast("double")).alias("coverage"))


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman over the pairs without nulls; null under three pairs. Ties get their average rank."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        w, same = Window.partitionBy(*keys).orderBy(c), Window.partitionBy(*keys, c)
        d = d.withColumn(f"_r{c}", F.rank().over(w) + (F.count("*").over(same) - 1) / 2)
    n = F.count("*")
    return d.groupBy(*keys).agg(n.alias("n"), F.when(n >= 3, F.corr(a, b)).alias("pearson"), F.when(n >= 3, F.corr(f"_r{a}", f"_r{b}")).alias("spearman"))


def verdict(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The search model of largest oos_r2 (the earlier of ``order`` on a tie): helps, how strongly, and with what confidence."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    best = table.filter(rank > 0).groupBy(*keys).agg(F.max_by(F.struct("model", "oos_r2", "dm_p", "cw_p"), F.struct("oos_r2", -rank)).alias("b")).select(*keys, "b.*")
    yes = lambda c: F.coalesce(c, F.lit(False))
    helps = yes((F.col("oos_r2") > 0.02) & (yes(F.col("cw_p") < 0.10) | yes(F.col("dm_p") < 0.10)))
    strong = yes((F.col("oos_r2") > 0.15) & (F.col("cw_p") < 0.05) & (F.col("dm_p") < 0.10))
    out = best.withColumn("strength", F.when(strong, "strong").when(helps, "moderate").otherwise("none"))
    return out.withColumn("confidence", F.when(strong, "high").when(helps, "medium").otherwise("low"))


def compare(preds: DataFrame, keys: list[str], bench: str | Column, history: DataFrame, period: int, h: int = 1, window: tuple[int, int] | None = None) -> DataFrame:
    """One row a model over the targets that all models of a series have, perhaps without a window of them: errors, skill and
    hit-rate of directions, scaled error, and both tests against ``bench`` (null for the benchmark itself)."""
    d = common_sample(preds, keys)
    d = exclude(d, *window) if window else d
    at, lags = [*keys, "model"], max(h, 1)
    out = metrics(d, keys, bench).join(mase(d, history, keys, period), at, "left")
    out = out.join(diebold_mariano(d, keys, bench, lags).drop("n"), at, "left")
    return out.join(clark_west(d, keys, bench, lags).drop("n"), at, "left")


def best_of(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, bench): the model of ``order`` with the least mean absolute error, the earlier one on a tie."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return table.filter(rank > 0).groupBy(*keys).agg(F.min_by("model", F.struct("mae", rank)).alias("bench"))


def confidence(full: DataFrame, excluded: DataFrame | None, keys: list[str], regime: DataFrame | None = None) -> DataFrame:
    """``full`` verdicts with their class of confidence: the excluded view without any gain lowers high to medium, and a
    present regime (keys, bench_mae, model_mae) in which the benchmark errs less lowers a chosen model's class by one, but not
    under low."""
    level = F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "moderate", 2).otherwise(1)
    d = full.drop("confidence")
    if excluded is not None:
        d = d.join(excluded.select(*keys, F.col("strength").alias("_x")), keys, "left")
        level = F.when((level == 3) & (F.col("_x") == "none"), 2).otherwise(level)
    if regime is not None:
        d = d.join(regime.select(*keys, "bench_mae", "model_mae"), keys, "left")
        worse = F.coalesce((F.col("bench_mae") < F.col("model_mae")) & (F.col("strength") != "none"), F.lit(False))
        level = F.when(worse, F.greatest(level - 1, F.lit(1))).otherwise(level)
    return d.withColumn("confidence", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level)).drop("_x", "bench_mae", "model_mae")


def in_both_views(full: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, use): the search model is used only where it helps in the full view and without the window."""
    x = excluded.select(*keys, (F.col("strength") != "none").alias("_x"))
    return full.join(x, keys, "left").select(*keys, "model", ((F.col("strength") != "none") & F.coalesce("_x", F.lit(False))).alias("use"))


def up_probability(point: Column, last: Column, sd: Column) -> Column:
    """Chance that the target rises over its last value, with normal errors; null without a spread."""
    return normal_upper(F.when(sd > 0, (last - point) / sd))


def error_spread(preds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, sd): the population deviation of the errors; null for five or fewer."""
    e = F.col("y") - F.col("p")
    return preds.groupBy(*keys, "model").agg(F.when(F.count(e) > 5, F.stddev_pop(e)).alias("sd"))


def state_conformal(preds: DataFrame, keys: list[str], below: float, recent: int = 36, alpha: float = 0.1) -> DataFrame:
    """Half-widths from the errors of origins whose last value was under ``below``."""
    return conformal(preds.filter(F.col("base") < below), keys, recent, alpha)


def others_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """``v`` against the mean of the other rows of its group (leave one out); null in a group of one."""
    w = Window.partitionBy(*keys)
    n = F.count("v").over(w)
    return df.withColumn("others", F.when(n > 1, (F.sum("v").over(w) - F.col("v")) / (n - 1)))


def validated(table: DataFrame) -> DataFrame:
    """``passes`` by a rule set beforehand: at least 8 contests, a binomial p and a correlation p under 0.05 (n, p_half, r)."""
    n, r = F.col("n"), F.col("r")
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    out = table.withColumn("r_p", F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_p(t, n - 2)))
    return out.withColumn("passes", F.coalesce((n >= 8) & (F.col("p_half") < 0.05) & (F.col("r_p") < 0.05), F.lit(False)))


def slope(df: DataFrame, keys: list[str], recent: int = 8) -> DataFrame:
    """(keys, slope): the line through each series' last ``recent`` values; null under three."""
    last = Window.partitionBy(*keys).orderBy(F.desc("pidx"))
    d = df.filter("v is not null").withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= recent)
    return d.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.regr_slope("v", "pidx")).alias("slope"))
