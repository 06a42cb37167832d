"""File sources and sinks. Paths may be lists or patterns and may lie in any store that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIAL = "isPartial"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written to a folder of its own and read back, which ends its plan and survives lost executors.

    The folder lies in spark.checkpoint.dir; only a local master may go without one, in a temporary folder."""
    spark = df.sparkSession
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="augury-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cells(line: Column) -> Column:
    """The cells of a CSV line; quoted ones may hold commas and doubled quotes, but no line ends."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')
    return F.transform(raw, bare)


def _lines(spark: SparkSession, path) -> DataFrame:
    """One row a file: its lines, without a byte order mark. Each file is read as one text, since lines have no order in a
    split file; such downloads have some hundred lines."""
    return spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n").alias("lines"))


def wide_vintage(spark: SparkSession, path) -> DataFrame:
    """Vintage files (date, one column per keyword, perhaps isPartial), each by its own header, in long form: ds, keyword, v, is_partial."""
    d = _lines(spark, path).select(_cells(F.element_at("lines", 1)).alias("names"), F.explode(F.expr("slice(lines, 2, size(lines))")).alias("line"))
    d = d.filter("trim(line) <> ''").withColumn("cells", _cells(F.col("line"))).withColumn("at", F.array_position("names", PARTIAL).cast("int"))
    flag = F.coalesce(F.when(F.col("at") > 0, F.lower(F.try_element_at("cells", "at")).isin("true", "1")), F.lit(False))
    pairs = F.explode(F.expr("slice(arrays_zip(names, cells), 2, size(names) - 1)"))
    d = d.select(F.expr("try_cast(cells[0] AS date)").alias("ds"), flag.alias("is_partial"), pairs.alias("p")).filter(F.col("p.names") != PARTIAL)
    return d.select("ds", F.col("p.names").alias("keyword"), F.col("p.cells").try_cast("double").alias("v"), "is_partial")


def save_vintage(df: DataFrame, path: str, slug: str, vintage: str) -> None:
    """Appends a vintage; earlier ones are never changed."""
    df.withColumns({"slug": F.lit(slug), "vintage": F.lit(vintage)}).write.mode("append").partitionBy("slug", "vintage").parquet(path)


def load_vintages(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """All vintages; the slug prunes folders."""
    df = spark.read.parquet(path)
    return df if slug is None else df.filter(F.col("slug") == slug)


def latest(df: DataFrame, keys: list[str], drop_partial: bool = True) -> DataFrame:
    """Rows of the newest vintage of each request: one aggregate and a join on its keys."""
    newest = df.groupBy(*keys).agg(F.max("vintage").alias("vintage"))
    out = df.join(newest, [*keys, "vintage"], "left_semi")
    return out.filter(~F.col("is_partial")) if drop_partial else out


def manual_csv(spark: SparkSession, path: str) -> DataFrame:
    """A downloaded table with a preamble, BOM, region suffixes in its header and ``<1`` cells, in long form: ds, keyword, v.

    The preamble is what stands before the line that starts with a period's name."""
    head = r"(?i)^\"?(week|month|day|time|date)\b"
    d = _lines(spark, path).withColumn("at", F.array_position(F.transform("lines", lambda x: x.rlike(head)), True)).filter("at > 0")
    d = d.select(_cells(F.element_at("lines", F.col("at").cast("int"))).alias("names"), F.explode(F.expr("slice(lines, int(at + 1), size(lines))")).alias("line"))
    d = d.filter("trim(line) <> ''").withColumn("cells", _cells(F.col("line")))
    d = d.select(F.expr("try_cast(cells[0] AS date)").alias("ds"), F.explode(F.expr("slice(arrays_zip(names, cells), 2, size(names) - 1)")).alias("p"))
    name = F.trim(F.regexp_replace(F.col("p.names"), r": \([^)]*\)$", ""))
    v = F.trim(F.col("p.cells"))
    return d.select("ds", name.alias("keyword"), F.when(v == "<1", 0.5).otherwise(v.try_cast("double")).alias("v"))


def csv_series(spark: SparkSession, path: str, date: str | int = 0, value: str | int = 1, date_format: str | None = None) -> DataFrame:
    """ds, v of a table's two columns, by name or place; rows that do not parse go."""
    df = spark.read.option("header", True).csv(path)
    name = lambda c: df.columns[c] if isinstance(c, int) else c
    text = F.col(f"`{name(date)}`")
    ds = F.try_to_timestamp(text, F.lit(date_format)) if date_format else F.try_to_timestamp(text)
    return df.select(ds.cast("date").alias("ds"), F.col(f"`{name(value)}`").try_cast("double").alias("v")).na.drop()


def save_series(df: DataFrame, path: str) -> DataFrame:
    """Writes a series and returns its sidecar: rows, first, last."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"), F.min("ds").alias("first"), F.max("ds").alias("last"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The JSON lines of requests made."""
    return spark.read.schema("slug string, keywords array<string>, geo string, timeframe string, vintage string, rows long").json(path)


def related_queries(spark: SparkSession, path: str) -> DataFrame:
    """Expansion files, one JSON text each: term, kind (top, rising), pos, query, value."""
    part = "array<struct<query:string,value:long>>"
    df = spark.read.option("multiLine", True).schema(f"kind string, term string, data struct<top:{part},rising:{part}>").json(path)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"data.{k}").alias("rows")) for k in ("top", "rising")])
    d = df.select("term", F.explode(kinds).alias("k"))
    return d.select("term", "k.kind", F.posexplode("k.rows").alias("pos", "r")).select("term", "kind", "pos", "r.query", "r.value")


def monthly_json(spark: SparkSession, path: str) -> DataFrame:
    """Monthly statistics in nested JSON: series, ds, v. Annual rows (M13) and missing values (-) go."""
    row = "struct<year:string,period:string,value:string>"
    df = spark.read.option("multiLine", True).schema(f"Results struct<series:array<struct<seriesID:string,data:array<{row}>>>>").json(path)
    d = df.select(F.explode("Results.series").alias("s")).select("s.seriesID", F.explode("s.data").alias("r"))
    d = d.filter(F.col("r.period").rlike("^M(0[1-9]|1[0-2])$"))
    ds = F.to_date(F.concat_ws("-", "r.year", F.substring("r.period", 2, 2), F.lit("01")))
    return d.select(F.col("seriesID").alias("series"), ds.alias("ds"), F.col("r.value").try_cast("double").alias("v")).filter("v is not null")


def epiweek_start(code: Column) -> Column:
    """The Sunday that starts an epidemiological week (yyyyww): week 1 is the one with January 4."""
    fourth = F.make_date(F.floor(code / 100).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(fourth, (1 - F.dayofweek(fourth) + 7 * (code % 100 - 1)).cast("int"))


def weekly_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Weekly surveillance JSON: region, ds, v where the value is known."""
    df = spark.read.option("multiLine", True).schema(f"epidata array<struct<region:string,epiweek:int,`{value}`:double>>").json(path)
    d = df.select(F.explode("epidata").alias("e"))
    return d.select("e.region", epiweek_start(F.col("e.epiweek")).alias("ds"), F.col(f"e.`{value}`").alias("v")).filter("v is not null")


def resample(df: DataFrame, keys: list[str], freq: str, how: str, now: str | None = None) -> DataFrame:
    """Daily values by month (start) or by week ending on Saturday, the last value or the sum; the period that ``now`` is in goes."""
    ds = F.trunc("ds", "month") if freq == "M" else F.date_add("ds", (7 - F.dayofweek("ds")).cast("int"))
    agg = F.max_by("v", "ds") if how == "last" else F.sum("v") if how == "sum" else F.avg("v")
    out = df.groupBy(*keys, ds.alias("period")).agg(agg.alias("v")).withColumnRenamed("period", "ds")
    end = F.last_day("ds") if freq == "M" else F.col("ds")
    return out if now is None else out.filter(end <= F.lit(now).cast("date"))


LOADERS = {"csv": csv_series, "monthly": monthly_json, "weekly": weekly_json}


def truth(spark: SparkSession, spec: dict) -> DataFrame:
    """The target that a spec names: its kind, its path, and the loader's own options."""
    spec = dict(spec)
    return LOADERS[spec.pop("kind")](spark, spec.pop("path"), **spec)


def report_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text per key: points as [date, value] in order, nan and infinite values as null."""
    v = F.when(F.isnan("v") | F.col("v").isin(float("inf"), float("-inf")), None).otherwise(F.col("v"))
    points = F.array_sort(F.collect_list(F.struct(F.date_format("ds", "yyyy-MM-dd").alias("ds"), v.alias("v"))))
    return df.groupBy(*keys).agg(F.to_json(points).alias("json"))
