"""Every query that has SQL gives the rows that DuckDB gives, and at least one."""

import duckdb
import pandas as pd
import pytest

from siltstream.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def said(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(map(said, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    expected = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a, b = rows(got, columns), rows(expected, columns)
    assert a == b
    assert a


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def on_orders(spark, path, name: str, keys: list[tuple[int, int]]) -> tuple[list[tuple], list[tuple]]:
    """What a query on (o_orderkey, o_custkey) and its SQL give."""
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet/*.parquet'")
    got, expected = QUERIES[name](spark, str(path)).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    return rows(got, columns), rows(expected, columns)


def test_timecodes_from_100_hours_on(spark, tmp_path):
    hours = 3600 * 48_000 / 7919  # orders of an hour
    keys = [int(h * hours) + i for h in (0, 9, 10, 99, 100, 101, 412, 999, 1000, 12_345) for i in range(3)]
    got, expected = on_orders(spark, tmp_path, "timecodes", [(k, 0) for k in keys])
    assert got == expected and len(got) == len(keys)


def test_titles_with_customers_that_look_like_years(spark, tmp_path):
    keys = [(7 * i + j, c) for i, c in enumerate([189, 1899, 1900, 1954, 1995, 1999, 2000, 2019, 2047, 2099, 2100, 19_541, 195_400]) for j in range(6)]
    got, expected = on_orders(spark, tmp_path, "titles", keys)
    assert got == expected and len(got) == len(keys)
