"""Every query that has SQL gives exactly the rows the SQL gives."""

import pytest

import __spark_entry__ as driver
import oracle
from staylens.plans import catalog

WITH_SQL = sorted(catalog.ORACLES)
WITHOUT_SQL = sorted(set(catalog.QUERIES) - set(WITH_SQL))


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() == 3


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(name, spark, sf_dir, con):
    assert oracle.compare(spark, con, sf_dir, driver.queries()[name], driver.oracle_sql()[name]) is None


def test_only_models_lack_sql():
    assert all(n.split("_")[0] in ("rf", "dt", "gbt") for n in WITHOUT_SQL)
