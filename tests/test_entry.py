"""Every registered query of the ranking operators against its oracle on the smallest tables."""

import math
import os

import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
