"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytest.importorskip("duckdb")
if not os.path.isdir(SF_DIR):
    pytest.skip("no test data", allow_module_level=True)

from checks.compare import connect, differences  # noqa: E402
from checks.oracle import all_sql  # noqa: E402
from checks.queries import all_queries  # noqa: E402


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, db, name):
    assert differences(spark, db, SF_DIR, name) is None
