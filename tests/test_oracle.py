"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from tests.oracle import database, rows
from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = database(sf_dir).sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES
