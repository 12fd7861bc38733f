"""Every query with an oracle, against DuckDB on the same files."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from tidelake import queries as lake

TABLES = (*lake.TABLES, "documents")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float, Decimal)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 9)
    return str(value)[:19].replace(" 00:00:00", "")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(lake.oracle_sql()))
def test_query_equals_oracle(spark, sf, duck, name):
    got = lake.queries()[name](spark, sf)
    wanted = duck.execute(lake.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, wanted.fetchall())


def test_zone_conversion_covers_every_event(spark, sf, duck):
    assert lake.queries()["at_time_zone"](spark, sf).count() == duck.execute("SELECT COUNT(*) FROM events").fetchone()[0]


@pytest.mark.parametrize(("name", "table"), [("order_nulls_default", "part"), ("order_multi_key", "customer")])
def test_sorts_put_the_whole_table_in_order(spark, sf, duck, name, table):
    got = [[plain(v) for v in r] for r in lake.queries()[name](spark, sf).collect()]
    assert len(got) == duck.execute(f"SELECT COUNT(*) FROM {table}").fetchone()[0]
    assert got == [[plain(v) for v in r] for r in duck.execute(lake.oracle_sql()[name]).fetchall()]


def test_set_operations_take_whole_columns(spark, sf, duck):
    nations, sizes, supplied = ({r[0] for r in duck.execute(f"SELECT {c} FROM {t}").fetchall()} for c, t in (("c_nationkey", "customer"), ("p_size", "part"), ("s_nationkey", "supplier")))
    got = {name: sorted(r.k for r in lake.queries()[name](spark, sf).collect()) for name in ("intersect", "except")}
    assert got == {"intersect": sorted(nations & sizes), "except": sorted(sizes - supplied)}
    assert nations - sizes and sizes - nations and sizes & supplied


def test_parquet_inspection(spark, sf):
    rows = lake.queries()["parquet_inspection"](spark, sf).collect()
    assert {(r.file, r.column_path, r.file_rows) for r in rows} >= {("nation.parquet", "n_name", 25), ("region.parquet", "r_regionkey", 5)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
