"""Every query against the SQL that defines it, on the smallest tables."""

from __future__ import annotations

import pytest

from glimpsar.plans import catalog

from .oracle import rows, views

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, duck, name):
    mine, theirs = catalog.queries()[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 19  # twenty, less the photo that is asked about
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
