"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["q_score_labels", "q_notes", "q_feel_curve", "q_regression_report", "q_pair_disagreement", "q_search_pages", "q_chart_metadata", "q_run_decision"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 90


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, base, name):
    from __spark_entry__ import oracle_sql, queries

    frame = queries()[name](spark, FOLDER)
    cursor = base.execute(oracle_sql()[name])
    expected = normal([item[0] for item in cursor.description], cursor.fetchall())
    assert normal(frame.columns, [tuple(row) for row in frame.collect()]) == expected
