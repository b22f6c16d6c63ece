"""Every registered image query against its SQL over the smallest tables, and the registry's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lumengrid.plans import catalog

NAMES = sorted(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(catalog.queries()) - set(NAMES)):
        assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_holds_every_image_query():
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
