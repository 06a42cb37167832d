"""Line dedup by site-relative frequency: lines on more than a given part of a site's pages go.

A site has fewer than (mean distinct lines per page / ratio) such lines, so the list kept per site is short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_lookup

RATIO, LEAST = 0.02, 5


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST, copies: bool = True) -> DataFrame:
    """(host, line hash, pages, total): lines on at least ``least`` pages and over ``ratio`` of the host's pages.

    Without ``copies``, pages of a host with the same lines (blank ones and outer spaces aside) are one page in both counts."""
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    body = F.split(F.coalesce("text", F.lit("")), "\n")
    hashes = F.array_distinct(F.transform(F.filter(body, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))
    seen = docs.select(site.alias("site"), hashes.alias("lines"))
    if copies:
        totals = seen.groupBy("site").agg(F.count("*").alias("total"))
        pages = seen.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count("*").alias("pages"))
    else:
        seen = seen.withColumn("page", F.xxhash64("lines"))
        totals = seen.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("total"))
        pages = seen.select("site", "page", F.explode("lines").alias("line")).distinct().groupBy("site", "line").agg(F.count("*").alias("pages"))
    return pages.filter(F.col("pages") >= least).join(totals, "site").filter(F.col("pages") > ratio * F.col("total"))


def dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST, copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text`` (and n_chars, if there, counted anew).

    Every row stays, repeated ones too; a null text stays null and a text of nothing but boilerplate becomes empty. A null host
    is the host named by the empty string. Blank lines are never boilerplate, and a line at the ratio itself stays. An empty
    table stays empty; other columns, whatever their names, are carried. A very long text is one row's array of lines."""
    scratch = Scratch(docs.sparkSession)
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    bad = boilerplate(docs, host, ratio, least, copies).groupBy("site").agg(F.collect_set("line").alias("bad"))
    sites = scratch.cut(docs.groupBy(site.alias("site")).agg(F.count("*").alias("rows")).join(bad, "site", "left"), "sites", keep=True)
    # The row travels as one value, so that no column of it can clash; sites of many rows get their list by broadcast.
    rows = docs.select(site.alias("site"), F.struct(*docs.columns).alias("row"))
    rows = hot_lookup(rows, sites, "site", "rows", sites.agg(F.sum("rows")).first()[0] or 0)
    kept = F.expr("array_join(filter(split(row.text, '\\n'), x -> not array_contains(bad, xxhash64(trim(x)))), '\\n')")
    text = F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(kept)
    n_chars = F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))
    new = {"text": text, "n_chars": n_chars}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
