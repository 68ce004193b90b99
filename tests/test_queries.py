"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

# no Python in the hot path, no pairing of everything with everything
BANNED = ["PythonUDF", "EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return ("number", round(value, 9) if math.isfinite(value) else str(value))
        if isinstance(value, int) and not isinstance(value, bool):
            return ("number", float(value))
        return (type(value).__name__, str(value))

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_its_sql(spark, duck, name):
    found = entry_points.queries()[name](spark, SF_DIR)
    rows = found.collect()
    assert rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in BANNED if node in plan]
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable(rows, found.columns) == comparable(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
