"""File sources and sinks on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from augury.operators import combine as C
from augury.sources import files as S

D = dt.date


def test_vintages_append_and_the_latest_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,cold,flu,isPartial\n2020-01-05,10,<1,False\n2020-01-12,20,5,True\n")
    long = S.wide_vintage(spark, str(tmp_path / "a.csv"))
    got = {(r.ds, r.keyword): (r.v, r.is_partial) for r in long.collect()}
    assert got[D(2020, 1, 5), "flu"] == (None, False) and got[D(2020, 1, 12), "cold"] == (20.0, True)
    S.save_vintage(long.withColumn("v", F.col("v") + 1), f"{tmp_path}/v", "x", "2020-01")
    S.save_vintage(long, f"{tmp_path}/v", "x", "2020-02")
    new = S.latest(S.load_vintages(spark, f"{tmp_path}/v", "x"), ["slug"]).orderBy("keyword").collect()
    assert [(r.keyword, r.v) for r in new] == [("cold", 10.0), ("flu", None)]
    assert S.load_vintages(spark, f"{tmp_path}/v").count() == 8


def test_manual_download(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Category: All\n\nWeek,cold: (Place),flu: (Place)\n2020-01-05,10,<1\n2020-01-12,x,5\n", encoding="utf-8")
    got = sorted((r.keyword, r.ds, r.v) for r in S.manual_csv(spark, str(tmp_path / "m.csv")).collect() if r.v is not None)
    assert got == [("cold", D(2020, 1, 5), 10.0), ("flu", D(2020, 1, 5), 0.5), ("flu", D(2020, 1, 12), 5.0)]


def test_csv_series_and_sidecar(spark, tmp_path):
    (tmp_path / "t.csv").write_text("day,value\n2020-01-02,2\n2020-01-01,1\nbad,3\n2020-01-03,\n")
    df = S.truth(spark, {"kind": "csv", "path": str(tmp_path / "t.csv"), "value": "value"})
    assert sorted(tuple(r) for r in df.collect()) == [(D(2020, 1, 1), 1.0), (D(2020, 1, 2), 2.0)]
    assert tuple(S.save_series(df, f"{tmp_path}/out").first()) == (2, D(2020, 1, 1), D(2020, 1, 2))


def test_json_statistics(spark, tmp_path):
    rows = [{"year": "2020", "period": p, "value": v} for p, v in (("M01", "1.5"), ("M02", "-"), ("M13", "9"))]
    (tmp_path / "b.json").write_text(json.dumps({"Results": {"series": [{"seriesID": "U", "data": rows}]}}))
    assert [tuple(r) for r in S.monthly_json(spark, str(tmp_path / "b.json")).collect()] == [("U", D(2020, 1, 1), 1.5)]
    (tmp_path / "w.json").write_text(json.dumps({"epidata": [{"region": "nat", "epiweek": 202001, "ili": 3.0}, {"region": "nat", "epiweek": 202053, "ili": None}]}))
    assert [tuple(r) for r in S.weekly_json(spark, str(tmp_path / "w.json"), "ili").collect()] == [("nat", D(2019, 12, 29), 3.0)]


def test_expansion(spark, tmp_path):
    data = {"top": [{"query": "a", "value": 9}, {"query": "b", "value": 8}], "rising": [{"query": "c", "value": 1}, {"query": "a", "value": 2}]}
    (tmp_path / "q.json").write_text(json.dumps({"kind": "related_queries", "term": "t", "data": data}))
    rel = S.related_queries(spark, str(tmp_path / "q.json")).withColumn("seed_pos", F.lit(0))
    assert sorted(r.query for r in C.expand(rel, 3).collect()) == ["a", "b", "c"]
    assert sorted(r.query for r in C.expand(rel, 1).collect()) == ["a"]


def test_resample_and_report(spark):
    df = spark.createDataFrame([("k", D(2020, 1, d), float(d)) for d in range(1, 12)], "key string, ds date, v double")
    week = S.resample(df, ["key"], "W", "last", now="2020-01-11")
    assert sorted((r.ds, r.v) for r in week.collect()) == [(D(2020, 1, 4), 4.0), (D(2020, 1, 11), 11.0)]
    assert S.resample(df, ["key"], "M", "sum", now="2020-01-15").count() == 0
    one = S.report_json(week.withColumn("v", F.when(F.col("v") > 5, float("nan")).otherwise(F.col("v"))), ["key"]).first()
    assert json.loads(one.json)[0] == {"ds": "2020-01-04", "v": 4.0}


def test_vintages_each_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,cold,flu,isPartial\n2020-01-05,1,2,False\n2020-01-12,3,,True\n')
    (tmp_path / "b.csv").write_text('date,flu,"cough, dry"\n2020-01-05,7,8\n')
    rows = {(str(r.ds), r.keyword, r.v, r.is_partial) for r in S.wide_vintage(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert rows == {("2020-01-05", "cold", 1.0, False), ("2020-01-05", "flu", 2.0, False), ("2020-01-12", "cold", 3.0, True), ("2020-01-12", "flu", None, True),
                    ("2020-01-05", "flu", 7.0, False), ("2020-01-05", "cough, dry", 8.0, False)}
