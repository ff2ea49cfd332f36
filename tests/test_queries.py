import pytest

from quillgrid import store_queries  # noqa: F401  registers its queries
from quillgrid.queries import ORACLES, QUERIES
from tests.oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    mine, theirs = both(spark, QUERIES[name], ORACLES[name], SF)
    assert mine == theirs


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"revision_hashes"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
