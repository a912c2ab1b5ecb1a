"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from assaykit.plans import PLANS

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, float):
        v = float(v)
        return "nan" if math.isnan(v) else f"{round(v, 9) + 0.0:.9g}"
    return f"{float(v):.9g}" if isinstance(v, int) and abs(v) < 2**53 else str(v)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    got = comparable(df.columns, df.collect())
    if name not in oracle_sql():
        assert got
        return
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == comparable(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 6


def test_every_query_has_sql():
    assert set(PLANS) <= set(oracle_sql())
