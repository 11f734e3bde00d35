"""Queries that SQL can express, beside that SQL."""

import pytest

from checks.compare import connect, rows_of
from staffmart.llm.queries import llm_queries, llm_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_equals_its_sql(spark, name):
    df = llm_queries()[name](spark, FOLDER)
    result = connect(FOLDER).execute(llm_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
