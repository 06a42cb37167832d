"""Gaps longer than the interpolation limit, which the daily tables hardly hold."""

from augury.operators import series as S


def test_long_gap(spark):
    rows = [("a", 1, 1.0), ("a", 7, 13.0), ("b", 4, 2.0)]
    full = S.fill_calendar(spark.createDataFrame(rows, "key string, pidx long, v double"), ["key"])
    assert sorted((r.key, r.pidx) for r in full.filter("v is null").collect()) == [("a", i) for i in range(2, 7)]
    got = sorted((r.key, r.pidx, r.v) for r in S.interpolate(full, ["key"]).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 5.0), ("a", 4, 7.0), ("a", 7, 13.0), ("b", 4, 2.0)]
