"""Every registered query against DuckDB on the same tables."""

import pytest

from veilstone.plans import interval_queries, job_queries, matching_queries, report_queries, subtitle_queries  # noqa: F401
from veilstone.plans.registry import ORACLES, QUERIES

from .duck import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
