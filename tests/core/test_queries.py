import pytest

import __spark_entry__
from tests.oracle import FOLDER, same
from tidemark.plans.all import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_planted_violations_are_found(spark):
    """Rates of detection that don't depend on the visits are 1."""
    got = {r.case_type: r.detected for r in QUERIES["negative_detection"](spark, FOLDER).collect()}
    assert all(got[k] == 1.0 for k in ("pair", "illegal", "restricted", "dose")) and 0 < got["swapped_goal"] < 1
