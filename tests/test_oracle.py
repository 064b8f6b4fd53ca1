import pytest

import __spark_entry__ as entry
from tests.oracle import compare, database

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(ROOT)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    """Result against SQL, and a plan without products of tables and without Python on single rows."""
    assert compare(spark, db, ROOT, name, entry.queries()[name], entry.oracle_sql().get(name)) == ""
