"""The queries that have SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from siltstream.llm.queries import ORACLE_SQL, QUERIES


def said(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expected = con.sql(ORACLE_SQL[name])
    columns = sorted(expected.columns)
    got = QUERIES[name](spark, sf_dir)
    assert columns == sorted(got.columns)
    a = sorted(tuple(map(said, r)) for r in got.select(columns).collect())
    assert a == sorted(tuple(map(said, r)) for r in expected.select(*columns).fetchall())
    assert a
