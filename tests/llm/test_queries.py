import pytest

from quillgrid.llm.queries import ORACLES, QUERIES
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    mine, theirs = both(spark, QUERIES[name], ORACLES[name], small)
    assert mine and mine == theirs


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11))
