"""Every registered query with check SQL agrees with DuckDB on the small tables."""
import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

from pixtables import plans

QUERIES, SQL = entry.queries(), dict(plans.ORACLES)  # optional subpackages test their own
# these two are covered at full scale by tests/oracle_check.py
SLOW = {"three_role_crossmatch", "pattern_noise"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query(name, spark, sf, con):
    spark.catalog.clearCache()
    msg = compare(name, QUERIES[name](spark, sf), SQL[name], con)
    assert msg.startswith("ok")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "image_id" and df.limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(QUERIES)
