"""Every registered query of the log engine against its SQL."""

import pytest

from cindermill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == catalogue.SHOWN
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
