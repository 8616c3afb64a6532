"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from opsloom.plans.registry import QUERIES
from opsloom.plans.views import SCHEMAS

FOLDER = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER)
    expected = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    rows = expected.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert comparable(got.columns, got.collect()) == comparable(columns, rows)
    assert rows or name in ("lambda_inactive",)


@pytest.mark.parametrize("name", TABLES)
def test_declared_schemas_are_those_of_the_files(spark, name):
    declared = spark.createDataFrame([], SCHEMAS[name]).dtypes
    assert spark.read.parquet(f"{FOLDER}/{name}.parquet").dtypes == declared


def test_entry(spark):
    assert contract.entry(spark).count() > 0
