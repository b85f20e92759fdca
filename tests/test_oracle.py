"""Every query with SQL against DuckDB on the small tables, the others for rows only."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from checks.registry import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if math.isfinite(value) and value == int(value) else value
    return value


def rows_of(rows, order):
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda row: [(v is None, str(v)) for v in row]
    )


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    got = rows_of(df.collect(), [df.columns.index(c) for c in names])
    want = rows_of(cursor.fetchall(), [columns.index(c) for c in names])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, data, name):
    assert entry.queries()[name](spark, data).collect()


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["Rank", "ID", "Prob_activo", "Prediccion", "Filtros"]
    ranks = [r["Rank"] for r in df.collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
