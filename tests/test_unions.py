"""Queries on unions of parts that are dealt alike, where adaptive execution coalesces each part's shuffle by itself.

Larger tables come to that by themselves; here broadcasts are off and partitions may be of any size.
"""

import pytest
from pyspark.sql.conf import RuntimeConfig

from quillgrid import store_queries  # noqa: F401  registers its queries
from quillgrid.queries import ORACLES, QUERIES
from tests.oracle import both

SET = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.unionOutputPartitioning": "true",
}
STORES = ["replica_docs", "replica_selected", "conflicts_in_feeds", "store_bulk_get", "store_feed_scalars", "store_feed_user_filter", "store_find_scan", "store_point_reads", "store_view", "store_view_docs", "store_view_reduce", "stream_latest", "stream_view", "conflicts_in_documents"]


@pytest.fixture
def dealt(spark):
    old = {k: spark.conf.get(k, None) for k in SET}
    for k, v in SET.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(("name", "size"), [("ancestry", "sf0.01"), ("map_documents", "sf0.01"), *((n, "sf0.001") for n in STORES)])
def test_query_equals_sql_whatever_is_dealt_alike(dealt, name, size):
    sf = f"/root/testdata/{size}/."  # a path of its own: stores are made once for a path
    mine, theirs = both(dealt, QUERIES[name], ORACLES[name], sf)
    assert mine == theirs


@pytest.fixture
def held(dealt, monkeypatch):
    """Whoever owns the session keeps unionOutputPartitioning on."""
    put = RuntimeConfig.set
    monkeypatch.setattr(type(dealt.conf), "set", lambda self, key, *a: None if key == "spark.sql.unionOutputPartitioning" else put(self, key, *a))
    dealt.conf.unset("spark.sql.unionOutputPartitioning")  # on by default
    assert dealt.conf.get("spark.sql.unionOutputPartitioning") == "true"
    yield dealt
    monkeypatch.undo()


@pytest.mark.parametrize(("name", "size"), [("ancestry", "sf0.01"), ("map_documents", "sf0.01"), *((n, "sf0.001") for n in STORES)])
def test_query_equals_sql_when_the_session_keeps_its_setting(held, name, size):
    sf = f"/root/testdata/{size}/./."
    mine, theirs = both(held, QUERIES[name], ORACLES[name], sf)
    assert mine == theirs
