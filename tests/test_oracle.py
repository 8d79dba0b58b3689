"""Registered queries against their DuckDB twins on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from aerolytics.plans.catalog import QUERIES
from scripts.check_oracle import TABLES, rows
from tests.conftest import SF

FAST = ["ingest_samples", "ingest_issues", "describe", "statistics", "correlation_matrix", "limit_check",
        "outliers_iqr", "fft", "psd_welch", "templates", "missing_values", "series_area", "report_tables",
        "export_metadata"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql_or_is_rows_only():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert set(QUERIES) <= set(s)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) >= {"flight_id", "parameter", "status"}
    assert df.count() > 0
