"""Registered queries next to their checking SQL on the smallest tables.

By default the headline queries and one of each further kind run; ALL_QUERIES=1
runs every registered query (about ten minutes).
"""

import os

import bench
import check
import pytest

import __spark_entry__ as entry_module
from tickerlake.plans import catalog

SF = "/root/testdata/sf0.001"
MORE = ["alias_conflicts", "resolve_fuzzy_alias", "attribution_rows", "implied_values", "merge_reference", "apply_overrides", "constraint_audit", "sla_breaches",
        "retry_exhaustion_incidents", "value_bridge", "validate_contract", "read_zipped_csv", "raw_zone_read_current", "stream_dedupe_payloads", "unpivot_statements", "coverage_map"]
NAMES = sorted(catalog.queries()) if os.environ.get("ALL_QUERIES") else bench.HEADLINE + MORE


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) <= set(entry_module.queries())


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = entry_module.oracle_sql()[name]
    assert check.compare(entry_module.queries()[name](spark, SF), con, sql) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["instrument_id", "trade_date", "close_px", "sma_50"]
    assert df.count() > 0
