"""The corpus queries that SQL can state, against DuckDB on the same files."""

from __future__ import annotations

import duckdb
import pytest

from tidelake.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(q.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    frame = q.queries()[name](spark, sf)
    assert sorted(frame.columns) == sorted(columns)
    wanted = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in frame.select(columns).collect()) == wanted
