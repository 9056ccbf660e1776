"""Every registered query runs on the smallest tables and agrees with its SQL where there is one."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from scriptoria.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_contract():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).columns == ["query", "rank", "doc_id", "tf", "score", "snippet"]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    status, n, _, _, info = compare(spark, sf, name, con)
    assert status in ("ok", "rows-only"), info
    assert n > 0, "no rows"
