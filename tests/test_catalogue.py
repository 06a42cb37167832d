"""Each series query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from augury.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def norm(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: None if x is None else round(float(x), 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted(tuple(str(fix(r[i])) for i in at) for r in rows), [names[i] for i in at]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "part", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    got, want = norm([tuple(r) for r in df.collect()], df.columns), norm(cur.fetchall(), names)
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0]) > 0
    assert got[0] == want[0]
