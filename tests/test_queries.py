"""Every registered query builds on the small tables, and SQL keys belong to queries."""

import pytest

import __spark_entry__ as entry
from tidemark import plans

DIR = "/root/testdata/sf0.001"


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 200


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - {"direction_classifier", "feature_contribution", "direction_walk_forward"}))
def test_query_builds(spark, name):
    """Analysis and a schema without nameless columns; results are compared by tools/check.py."""
    df = plans.queries()[name](spark, DIR)
    assert df.columns and len(set(df.columns)) == len(df.columns)
