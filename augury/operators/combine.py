"""Operators that bring series together: as-of lags, batches on an anchor, splices, expansion, attention shares."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from augury.operators.series import back, fill_calendar, interpolate


def derive(df: DataFrame, keys: list[str], kind: str, scale: float | None = None) -> DataFrame:
    """pct_change, logdiff, diff or log of ``v`` after gaps of up to three periods are filled by lines, so that a missing
    period does not make one change of two; a period without a predecessor goes, but for log. ``scale`` is 100 for changes in
    per cent and logarithms, else 1."""
    df = interpolate(fill_calendar(df, keys), keys)
    prev = back("v", 1, keys)
    v = {"pct_change": F.try_divide(F.col("v"), prev) - 1, "logdiff": F.ln("v") - F.ln(prev), "diff": F.col("v") - prev, "log": F.ln("v")}[kind]
    scale = scale if scale is not None else 100.0 if kind in ("pct_change", "logdiff") else 1.0
    return df.withColumn("v", v * scale).filter("v is not null")


def fourier(df: DataFrame, period: int, k: int) -> DataFrame:
    """sin1, cos1, ... of the period's position in its season."""
    angle = lambda j: F.col("pidx") * (2 * 3.141592653589793 * j / period)
    return df.withColumns({f"{n}{j}": f(angle(j)) for j in range(1, k + 1) for n, f in (("sin", F.sin), ("cos", F.cos))})


def normalise(df: DataFrame, request: list[str]) -> DataFrame:
    """Joint scale of a request: its largest value is 100."""
    return df.withColumn("v", F.round(100 * F.try_divide("v", F.max("v").over(Window.partitionBy(*request)))))


def _past(low: DataFrame, high: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """(keys, ds, _p): the last ``lags`` + 1 values of ``high`` (keys, ds, v) dated at or before ``low``'s ``ds``, the latest first.

    One sort per series over the union of both sides in place of a range join. Low rows with fewer values before
    them have a null among theirs. Values of one date count before the low row of that date."""
    w = Window.partitionBy(*keys)
    back = w.orderBy("ds")
    h = high.select(*keys, "ds", F.col("v").cast("double").alias("v"))
    past = F.array(*[F.lag("v", j).over(back) if j else F.col("v") for j in range(lags + 1)])
    h = h.withColumn("_p", past).select(*keys, "ds", "_p", F.lit(0).alias("_o"))
    u = h.unionByName(low.select(*keys, "ds", F.lit(None).cast("array<double>").alias("_p"), F.lit(1).alias("_o")))
    return u.withColumn("_p", F.last("_p", True).over(w.orderBy("ds", "_o").rowsBetween(Window.unboundedPreceding, 0))).filter("_o = 1")


def _weighted(weights: list[float]):
    out, total = F.lit(0.0), sum(weights)
    for j, x in enumerate(weights):
        out = out + F.col("_p")[j] * (x / total)
    return out


def asof_lags(low: DataFrame, high: DataFrame, keys: list[str], lags: int, weights: list[float]) -> DataFrame:
    """The weighted sum of the last ``lags`` + 1 values of ``high`` at or before ``low``'s ``ds``; low rows with fewer go."""
    return _past(low, high, keys, lags).select(*keys, "ds", _weighted(weights[: lags + 1]).alias("v")).filter("v is not null")


#: The pairs of the exponential lag weights that are tried.
MIDAS_GRID = ((0.0, 0.0), (-0.3, 0.0), (-0.7, 0.0), (0.3, -0.05), (0.0, -0.05), (-0.1, -0.02))


def midas_grid(low: DataFrame, high: DataFrame, keys: list[str], lags: int, grid=MIDAS_GRID) -> DataFrame:
    """(keys, ds, a, b, v): ``asof_lags`` with weights exp(a j + b j^2) for every pair of ``grid``, from one sort of each series."""
    own = [(a, b, [math.exp(a * j + b * j * j) for j in range(lags + 1)]) for a, b in grid]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _weighted(w).alias("v")) for a, b, w in own])
    return _past(low, high, keys, lags).select(*keys, "ds", F.explode(rows).alias("r")).select(*keys, "ds", "r.*").filter("v is not null")


def contest(shares: DataFrame, truth: DataFrame, national: DataFrame) -> DataFrame:
    """Each (year, place, share) beside the margin of ``truth`` (year, place, margin) and the share and margin of the year in
    ``national`` (year, nat_share, nat_margin): hit, whether the share's side won, rel_share and rel_margin, what is left without the
    nation's, and rel_hit, whether these agree.

    A share of one half, a null share or a place without a margin is neither hit nor miss. ``national`` is one row a year."""
    j = shares.join(truth, ["year", "place"], "left").join(national, "year", "left")
    j = j.withColumns({"rel_share": F.col("share") - F.col("nat_share"), "rel_margin": F.col("margin") - F.col("nat_margin")})
    agree = lambda side, margin: F.when(F.col(side) != 0, (F.col(side) > 0) == (F.col(margin) > 0))
    j = j.withColumn("_s", F.col("share") - 0.5)
    return j.withColumns({"hit": agree("_s", "margin"), "rel_hit": agree("rel_share", "rel_margin")}).select("year", "place", "share", "margin", "hit", "rel_share", "rel_margin", "rel_hit")


def anchored(df: DataFrame, anchor: str) -> DataFrame:
    """Batches (``batch``, keyword, pidx, v) on batch 0's scale by the mean of the anchor's values over zero; the anchor stays once."""
    means = df.filter((F.col("keyword") == anchor) & (F.col("v") > 0)).groupBy("batch").agg(F.avg("v").alias("m"))
    first = means.filter("batch = 0").select(F.lit(0).alias("one"), F.col("m").alias("m0"))
    scale = means.withColumn("one", F.lit(0)).join(F.broadcast(first), "one", "left").select("batch", F.coalesce(F.try_divide("m0", "m"), F.lit(1.0)).alias("r"))
    out = df.filter((F.col("keyword") != anchor) | (F.col("batch") == 0)).join(scale, "batch", "left")
    return out.select("keyword", "pidx", (F.col("v") * F.coalesce("r", F.lit(1.0))).alias("v"))


def batches(keywords: DataFrame, anchor: str, size: int = 4) -> DataFrame:
    """(batch, keyword): requests of ``size`` keywords and the anchor, in the order of ``pos``; a repeated keyword counts at its first place.

    ``keywords`` (pos, keyword) is a request's list, not data: its numbering is one task's work."""
    first = keywords.groupBy("keyword").agg(F.min("pos").alias("pos")).filter(F.col("keyword") != anchor)
    own = first.select(F.floor((F.row_number().over(Window.orderBy("pos")) - 1) / size).cast("int").alias("batch"), "keyword")
    return own.unionByName(own.select("batch", F.lit(anchor).alias("keyword")).distinct())


def individual(frames: DataFrame) -> DataFrame:
    """One series a keyword out of requests of one keyword each (pos, keyword, pidx, v); of repeated keywords the first request's."""
    first = frames.groupBy("keyword").agg(F.min("pos").alias("pos"))
    return frames.join(first, ["keyword", "pos"], "left_semi").select("keyword", "pidx", "v")


def union_columns(frames: DataFrame) -> DataFrame:
    """Full outer join of series by period, in long form: every keyword has a row, perhaps null, for each period of any."""
    grid = frames.select("keyword").distinct().crossJoin(frames.select("pidx").distinct())  # the result itself: keywords of one request by its periods
    return grid.join(frames.groupBy("keyword", "pidx").agg(F.min_by("v", "pos").alias("v")), ["keyword", "pidx"], "left")


def extend(df: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """With ``steps`` future periods a series, without values."""
    last = df.groupBy(*keys).agg(F.max("pidx").alias("hi"))
    ahead = last.select(*keys, F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + steps)).alias("pidx"), F.lit(None).cast("double").alias("v"))
    return df.select(*keys, "pidx", "v").unionByName(ahead)


def signal_info(signals: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, nonzero, corr): each signal's share of values over zero, and the correlation of its changes with the target's."""
    t = target.withColumn("_one", F.lit(1)).select("pidx", (F.col("v") - back("v", 1, ["_one"])).alias("dy"))
    d = signals.withColumn("dx", F.col("v") - back("v", 1, [key])).join(t, "pidx", "left")
    return d.groupBy(key).agg(F.round(F.avg((F.col("v") > 0).cast("double")), 2).alias("nonzero"), F.round(F.corr("dx", "dy"), 2).alias("corr"))


def splice(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``new``, and ``old`` before its start; a series that ``new`` lacks stays as it is."""
    start = new.groupBy(*keys).agg(F.min("pidx").alias("_s"))
    kept = old.join(start, keys, "left").filter("_s is null or pidx < _s").drop("_s")
    return kept.select(*keys, "pidx", "v").unionByName(new.select(*keys, "pidx", "v"))


def splice_stats(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    d = old.select(*keys, "pidx", F.col("v").alias("a")).join(new.select(*keys, "pidx", F.col("v").alias("b")), [*keys, "pidx"])
    diff = F.col("b") - F.col("a")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.max(F.abs(diff)).alias("max_diff"))


def expand(related: DataFrame, per_seed: int = 10) -> DataFrame:
    """(query, first): top queries of each seed and a third as many rising ones, each query once, at its first place.

    ``related`` has seed_pos, kind (top, rising), pos, query."""
    cap = F.when(F.col("kind") == "rising", F.lit(per_seed // 3)).otherwise(F.lit(per_seed))
    place = F.struct("seed_pos", F.when(F.col("kind") == "top", 0).otherwise(1).alias("k"), "pos")
    return related.filter(F.col("pos") < cap).groupBy("query").agg(F.min(place).alias("first"))


def salience(df: DataFrame, entity: str) -> DataFrame:
    """Attention shares of entities: last four weeks, the four before (the first four, where there are under eight), and the last four without the loudest of them."""
    total = Window.partitionBy("pidx")
    d = df.withColumn("_t", F.sum("v").over(total)).withColumn("share", F.try_divide("v", "_t"))
    weeks = df.groupBy("pidx").agg(F.sum("v").alias("t")).orderBy(F.desc("pidx")).limit(8)  # a report on the last eight weeks
    weeks = weeks.withColumn("_b", F.row_number().over(Window.orderBy(F.desc("pidx"))))
    spike = Window.orderBy(F.when(F.col("_b") <= 4, F.col("t")).desc_nulls_last(), "pidx")
    weeks = weeks.withColumn("_k", F.row_number().over(spike)).withColumn("_n", F.count("*").over(Window.partitionBy())).select("pidx", "_b", "_k", "_n")
    d = d.join(F.broadcast(weeks), "pidx")
    pick = lambda c: F.round(F.avg(F.when(c, F.col("share"))), 3)
    return d.groupBy(entity).agg(
        pick(F.col("_b") <= 4).alias("last4"), pick(F.col("_b") > F.col("_n") - 4).alias("prev4"), pick((F.col("_b") <= 4) & (F.col("_k") > 1)).alias("ex_spike"))


def correlations(df: DataFrame, key: str) -> DataFrame:
    """Correlation of every pair of keywords of one request group (tens of keywords), by period."""
    a, b = df.select(F.col(key).alias("a"), "pidx", F.col("v").alias("x")), df.select(F.col(key).alias("b"), "pidx", F.col("v").alias("y"))
    return a.join(b, "pidx").filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
