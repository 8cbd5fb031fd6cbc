"""Every query with SQL agrees with DuckDB on the small tables."""

from __future__ import annotations

import pytest
from conftest import ROOT, SF_DIR

import sys

sys.path.insert(0, str(ROOT / "tools"))

import check  # noqa: E402

import __spark_entry__ as driver  # noqa: E402


@pytest.fixture(scope="module")
def db():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_agrees_with_sql(spark, db, name):
    verdict, _ = check.compare(spark, db, SF_DIR, name)
    assert verdict.startswith("ok"), verdict


def test_keys_match():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_names_what_is_wrong(spark):
    found = {(r["check"], r["column"]) for r in driver.entry(spark).collect()}
    assert ("missing_value_threshold", "txn_amt") in found
    assert ("invalid_timestamp", "ingest_ts") in found
