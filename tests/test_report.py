"""Pages and stored runs of two series, one of them without results."""

import json

from augury.sinks import report as O


def made(spark):
    row = lambda ddl, *rows: spark.createDataFrame(rows, ddl)
    tables = {
        "metrics": row("key string, h int, model string, n long, mae double, oos_r2 double", ("a<b", 1, "naive", 9, 2.0, 0.0), ("a<b", 1, "ridge", 9, float("nan"), 0.25)),
        "verdicts": row("key string, h int, model string, chosen string, oos_r2 double, confidence string", ("a<b", 1, "ridge", "naive", 0.25, "low")),
        "forecasts": row("key string, h int, model string, pidx long, p double, lo double, hi double", ("a<b", 1, "naive", 24289, 1234.5, 1200.0, float("inf"))),
        "predictions": row("key string, h int, model string, pidx long, y double, p double", ("a<b", 1, "naive", 24288, 3.0, 4.0)),
    }
    y = row("key string, pidx long, v double", ("a<b", 24287, 1.0), ("a<b", 24288, None), ("empty", 24288, 2.0))
    return tables, y


def test_outputs(spark, tmp_path):
    tables, y = made(spark)
    O.store(tables, str(tmp_path))
    out = O.outputs(O.stored(spark, str(tmp_path)), y, ["key"], "Q & A")
    got = {r.key: r for r in out.collect()}
    r = json.loads(got["a<b"].json)
    assert [p["pidx"] for p in r["history"]] == [24287, 24288] and "v" not in r["history"][1]
    assert [m["model"] for m in r["metrics"]] == ["naive", "ridge"] and "mae" not in r["metrics"][1]
    assert "hi" not in r["forecasts"][0]
    page = got["a<b"].html
    assert "a&lt;b" in page and "a<b" not in page and "Q &amp; A" in page
    assert "1,234.50 for 2024-01-01" in page and "+25 %" in page and "(not used)" in page and "<polyline" in page
    assert json.loads(got["empty"].json)["metrics"] == [] and "Confidence<b>none" in got["empty"].html
    whole = O.summary(out, "All")
    assert whole.index("a&lt;b") < whole.index("empty")
    assert O.outputs(tables, y.limit(0), ["key"], "none").count() == 0


def test_periods():
    assert (O.period_start(24289, "M"), O.period_start(24288, "M")) == ("2024-01-01", "2023-12-01")
    assert (O.period_start(1, "W"), O.period_start(31, "D")) == ("1970-01-08", "1970-02-01")
    assert (O.number(None), O.number(float("nan")), O.number(1234.5), O.number(12), O.number(True)) == ("–", "–", "1,234.50", "12", "True")
