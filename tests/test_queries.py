"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    plain = lambda v: None if v is None or v != v else str(v)[:10] if hasattr(v, "isoformat") else round(v, 6) if isinstance(v, float) and math.isfinite(v) else int(v) if hasattr(v, "item") and float(v).is_integer() else v
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object)[cols].where(df.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
