"""Mixing sources to target weights: shares to a power, bisected to a target, realised as block permutations.

Weights are share**alpha, normalised. Alpha is the largest exponent (nearest the natural shares) whose entropy reaches a
target part of the maximum, or, without that, the least exponent that repeats no source more than a limit. The
budget is the least one that shows every source once, so no row is left out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: The table of sources is broadcast up to so many rows (under 1 MB), and joined by a shuffle beyond.
REPEAT, BLOCK, SMALL = 2.0, 4096, 10_000


def tokens():
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+")).cast("long")


def _measure(stats: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """(entropy over its maximum, greatest repetition) at each exponent; one aggregate, whatever the number of sources."""
    cols = []
    for j, a in enumerate(alphas):
        v = F.exp(F.lit(a) * F.col("ls"))
        cols += [F.sum(v).alias(f"z{j}"), F.sum(v * a * F.col("ls")).alias(f"e{j}"), F.max(v / F.exp("ls")).alias(f"hi{j}"), F.min(v / F.exp("ls")).alias(f"lo{j}")]
    r = stats.agg(F.count("*").alias("n"), *cols).first()
    return [((math.log(r[f"z{j}"]) - r[f"e{j}"] / r[f"z{j}"]) / max(math.log(r["n"]), 1e-12), r[f"hi{j}"] / r[f"lo{j}"]) for j in range(len(alphas))]


def exponent(stats: DataFrame, entropy: float | None = None, repeat: float = REPEAT) -> float:
    """Bisection in many parts: each pass cuts the bracket to a 32nd. ``stats`` has ``ls``, the log of the token share."""
    lo, hi = 0.0, 1.0
    good = (lambda m: m[0] >= entropy) if entropy is not None else (lambda m: m[1] <= repeat)
    for _ in range(6):
        grid = [lo + (hi - lo) * j / 32 for j in range(33)]
        fits = [good(m) for m in _measure(stats, grid)]
        if entropy is not None:  # true up to some exponent
            if fits[-1]:
                return hi
            at = max([j for j, ok in enumerate(fits) if ok], default=0)
            lo, hi = grid[at], grid[min(at + 1, 32)]
        else:  # true from some exponent on
            if fits[0]:
                return lo
            at = min([j for j, ok in enumerate(fits) if ok], default=32)
            lo, hi = grid[max(at - 1, 0)], grid[at]
    return lo if entropy is not None else hi


def weights(stats: DataFrame, entropy: float | None = None, repeat: float = REPEAT) -> DataFrame:
    """``stats`` (_src, size in tokens, rows) with each source's weight and how many times its tokens are shown."""
    total = stats.agg(F.sum("size")).first()[0] or 0
    empty = stats.withColumns({"weight": F.lit(0.0), "times": F.lit(1.0)})
    if not total:
        return empty
    live = stats.filter("size > 0").withColumn("ls", F.log(F.col("size") / F.lit(float(total))))
    v = F.exp(F.lit(exponent(live, entropy, repeat)) * F.col("ls"))
    z, top = live.agg(F.sum(v), F.max(F.col("size") / v)).first()
    plan = live.select("_src", "size", "rows", (v / z).alias("weight"), (v * top / F.col("size")).alias("times"))
    return plan.unionByName(empty.filter("size = 0"))


#: Columns that mixing adds; columns of ``docs`` with these names are replaced.
ADDED = ("n_tokens", "weight", "epoch", "place", "block", "slot")


def mix(docs: DataFrame, entropy: float | None = None, repeat: float = REPEAT, block: int = BLOCK, carry: bool = True) -> DataFrame:
    """Rows in training order of each source (epoch, place, slot): the columns of ``docs`` (or doc_id and source) with
    n_tokens, weight, epoch, place (the block's position in its epoch), block and slot (the row's position in its block).

    Each epoch permutes a source's blocks, and the rows of a block, anew; the last epoch stops at the first row that
    meets the source's budget. Every row is in epoch 0. A null source is a source of its own; rows without tokens (null or
    empty texts) are in epoch 0 alone. Repeated rows stand together, at the slot of the first of them. An empty table gives
    an empty result. Columns named like the added ones are replaced; a very long text counts whole, and is not split."""
    src = F.coalesce(F.col("source").cast("string"), F.lit("\0null"))
    n_tokens = tokens()
    key = F.xxhash64("doc_id", src, n_tokens, "text")
    light = cut(docs.select("doc_id", src.alias("_src"), n_tokens.alias("n_tokens"), key.alias("_key")), "mix")
    stats = cut(light.groupBy("_src").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("rows")), "sources")
    plan = weights(stats, entropy, repeat)
    plan = plan.select("_src", "weight", F.greatest("times", F.lit(1.0)).alias("times"), "size", F.ceil(F.col("rows") / block).alias("blocks"))
    rows = light.join(F.broadcast(plan) if stats.count() <= SMALL else plan, "_src").withColumn("block", F.pmod(F.col("_key"), F.col("blocks")))
    last = F.when(F.col("n_tokens") > 0, F.ceil(F.col("times") - 1e-9).cast("int") - 1).otherwise(0)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    sums = rows.groupBy("_src", "epoch", "block").agg(F.sum("n_tokens").alias("_n"))
    order = Window.partitionBy("_src", "epoch").orderBy(F.xxhash64("_src", "epoch", "block"), "block")
    starts = sums.withColumn("_from", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.withColumn("place", F.row_number().over(order).cast("long")).drop("_n")
    rows = rows.join(starts, ["_src", "epoch", "block"])
    inner = Window.partitionBy("_src", "epoch", "block").orderBy(F.xxhash64("_key", "epoch"), "_key", "doc_id")
    rows = rows.withColumn("slot", F.row_number().over(inner).cast("long"))
    before = F.col("_from") + F.coalesce(F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).filter((F.col("epoch") == 0) | (F.col("_before") < (F.col("times") - F.col("epoch")) * F.col("size") - 0.5))
    added = [F.col("block").cast("long").alias("block") if c == "block" else F.col(c) for c in ADDED]
    if not carry:
        return rows.select("doc_id", F.when(F.col("_src") != "\0null", F.col("_src")).alias("source"), *added)
    slots = rows.groupBy("_key", "epoch").agg(*[F.min(c).alias(c) for c in ADDED if c != "epoch"])
    slots = slots.select("_key", F.struct(*added).alias("_at"))
    # The row travels as one value, so that no column of it can clash with the helpers.
    out = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key")).join(slots, "_key")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *[F.col("_at").getField(c).alias(c) for c in ADDED])
