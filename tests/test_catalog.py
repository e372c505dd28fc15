"""Every query with an SQL statement, compared on the smallest test tables."""

import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_queries import rows_of  # noqa: E402

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def database():
    base = duckdb.connect()
    base.sql("SET TimeZone='UTC'")
    for path in FOLDER.glob("*.parquet"):
        base.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


def test_every_statement_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 12


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, database, name):
    frame = queries()[name](spark, str(FOLDER))
    result = database.sql(oracle_sql()[name])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(result.columns, result.fetchall())
