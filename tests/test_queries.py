"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from netquill.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(plans.ORACLE_SQL[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == cols
    want = sorted((tuple(plain(r[at.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want
