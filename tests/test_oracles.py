"""Every catalogued query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import types as T

import __spark_entry__ as driver

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(
        repr(tuple(None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in row))
        for row in df.itertuples(index=False)
    )


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_oracle(spark, small, sql, name):
    found = driver.queries()[name](spark, small)
    ours = found.toPandas()
    for f in found.schema.fields:
        # Without this, whole numbers beside nulls are floats here and whole numbers in DuckDB.
        if isinstance(f.dataType, T.IntegralType) and ours[f.name].isna().any():
            ours[f.name] = ours[f.name].astype("Int64")
    theirs = sql.execute(driver.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_entry(spark):
    assert driver.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
