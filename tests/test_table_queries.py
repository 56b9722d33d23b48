"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from carepath import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "tolist"):
        return x.tolist()
    if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
        return None
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(map(plain, r))) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, tmp_path, name):
    registry.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    got = db.sql(f"select * from '{tmp_path}/out/*.parquet'").df()
    want = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
