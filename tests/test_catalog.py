"""Every named query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def ordered(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert ordered(found.columns, found.collect()) == ordered(columns, expected.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_ranked_list(spark):
    ranked = QUERIES["flight_risk_ranked"](spark, SF_DIR).collect()
    top = QUERIES["flight_risk_top5"](spark, SF_DIR).collect()
    assert [r["FlightRiskScore"] for r in top] == sorted((r["FlightRiskScore"] for r in ranked), reverse=True)[:5]
    assert all(0 <= r["FlightRiskScore"] <= 100 for r in ranked)


def test_unchecked_queries_return_rows(spark):
    for name in ("chunk_recursive",):
        assert QUERIES[name](spark, SF_DIR).count() > 0
