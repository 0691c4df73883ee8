"""Every registered query against its SQL in DuckDB, and row for row without SQL."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from cairnlake.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = registry.plans()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float | Decimal):
        return None if isinstance(x, float) and math.isnan(x) else float(f"{float(x):.9g}") + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def compare(spark, duck, plan):
    df = plan.run(spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if plan.sql is None:
        return len(got)
    rel = duck.sql(plan.sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (names, len(bad), bad[:3])
    return len(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not there")
@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    compare(spark, duck, PLANS[name])
