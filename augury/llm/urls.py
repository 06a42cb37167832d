"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is listed as its canonical "host/path". A URL asks for each of its host's suffixes with each path beginning as long
as some listed path. The filter's blocks (four 64-bit words each) are a table joined by block number; keys whose bits
are all set go to the exact join, which removes false positives. Both joins are ordinary equi-joins: Spark broadcasts a
side only below its own size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER

#: The rules of the page query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The verdict of the method for a URL that no listed entry fits.
UNLISTED = "allow"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")


def parts(url="url"):
    """(host, path) columns of a URL; both empty where it is null or has no ://."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: str, blocks: int):
    h = F.xxhash64(F.lit(17), F.col(key))
    block = F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(blocks))
    words = [F.expr(f"shiftleft(1L, cast(pmod(shiftright({{h}}, {8 * j}), 64) as int))".format(h=f"xxhash64(17, {key})")) for j in range(4)]
    return block, words


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    block, words = _bits(key, blocks)
    named = [w.alias(f"w{j}") for j, w in enumerate(words)]
    return keys.select(block.alias("blk"), *named).groupBy("blk").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)])


def judge(pages: DataFrame, rules: DataFrame, unlisted: str = UNLISTED) -> DataFrame:
    """page_id, host, path, rule, verdict of each row; the longest fitting rule wins, and of equal ones the least verdict."""
    listed = rules.filter("host is not null and path is not null").withColumn("key", F.concat("host", "path"))
    listed = listed.groupBy("host", "path", "key").agg(F.min("verdict").alias("verdict"))
    blocks = max(listed.count() // 8, 64)
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # distinct lengths of listed paths, not of pages
    host, path = parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    asked = urls.select("host", "path").distinct()
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"
    heads = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]))
    ask = asked.filter("host <> ''").select("host", "path", F.explode(F.expr(suffixes)).alias("s"), heads.alias("heads"))
    ask = ask.select("host", "path", "s", F.explode("heads").alias("head")).withColumn("key", F.concat("s", "head"))
    block, words = _bits("key", blocks)
    ask = ask.withColumn("blk", block)
    hits = ask.join(bloom(listed, "key", blocks), "blk")
    for j, w in enumerate(words):
        hits = hits.filter(F.col(f"w{j}").bitwiseAND(w) == w)
    exact = hits.join(listed.select(F.col("host").alias("s"), F.col("path").alias("head"), "verdict"), ["s", "head"])
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), F.struct(F.length("key"), "verdict")).alias("r"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(unlisted)).alias("verdict"))
