import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillgrid.errors import Conflict, NotFound, QueryError
from quillgrid.functions.revid import parse_rev, rev_hash
from quillgrid.operators import revisions as R
from quillgrid.operators import scan, write
from quillgrid.operators.changes import ChangesQuery
from quillgrid.operators.replicate import Options, Scheduler, replicate
from quillgrid.sources.store import Server, Store


def digest(data):
    return "md5-" + base64.b64encode(hashlib.md5(data).digest()).decode()


FILES = [("z.bin", "application/x-zed", digest(b"zed bytes")), ("a.bin", "application/x-aay", digest(b"aay bytes"))]


@pytest.mark.parametrize(
    ("deleted", "parent", "raw", "files", "wanted"),
    [
        (False, None, "{}", [], "967a00dff5e02add41819138abb3284d"),
        (False, "1-967a00dff5e02add41819138abb3284d", "{}", [], "7051cbe5c8faecd085a3fa619e6e6337"),
        (True, "2-7051cbe5c8faecd085a3fa619e6e6337", "{}", [], "7379b9e515b161226c6559d90c4dc49f"),
        (False, None, '{"ünïcode":[],"x-9":[],"a":255}', [], "652e5812d67fdab021796340dd12c990"),
        (False, None, '{"zulu":[3,56,225],"b":"line\\nbreak","ünïcode":2147483648}', [], "75ded617a58ebe02d5480ffa49374b06"),
        (False, None, '{"kind":"att-doc","_attachments":{}}', FILES, "90f9593018325165de53ad9a5b480bc1"),
        (False, "1-90f9593018325165de53ad9a5b480bc1", '{"_rev":"1-90","kind":"att-doc-v2"}', FILES, "3e19fcaf0afd45d8f7068fde7f11398e"),
    ],
)
def test_revision_hash(deleted, parent, raw, files, wanted):
    assert rev_hash(deleted, parse_rev(parent) if parent else None, raw, files) == wanted


def tree(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], R.REVS)


@pytest.fixture(scope="module")
def forked(spark):
    return tree(spark, [
        ("d", 1, "a", None, None, False, None, 1),
        ("d", 2, "ffff", 1, "a", False, '{"v":1}', 2),
        ("d", 2, "0000", 1, "a", False, '{"v":2}', 3),
        ("e", 1, "x", None, None, False, None, 4),
        ("e", 2, "y", 1, "x", True, "{}", 5),
        ("f", 1, "p", None, None, False, '{"f":1}', 6),
    ]).cache()


def test_winner_conflicts_and_leaves(forked):
    won = {r["id"]: (r["num"], r["hash"], r["deleted"], r["seq"]) for r in R.winners(forked).collect()}
    assert won == {"d": (2, "ffff", False, 3), "e": (2, "y", True, 5), "f": (1, "p", False, 6)}
    assert {r["id"]: r["conflicts"] for r in R.conflicts(forked).collect()} == {"d": ["2-0000"]}
    assert {r["id"]: r["revs"] for r in R.all_leaves(forked).collect()}["d"] == ["2-ffff", "2-0000"]


def test_ancestry_and_open_revs(forked):
    got = R.ancestry(forked, R.leaves(forked)).where("id = 'd' and leaf_hash = 'ffff'").orderBy("depth").collect()
    assert [(r["num"], r["hash"]) for r in got] == [(2, "ffff"), (1, "a")]
    assert {r["rev"] for r in R.open_revs(forked, "d").collect()} == {"2-ffff", "2-0000"}
    assert {(r["rev"], r["ok"]) for r in R.open_revs(forked, "d", [(1, "a"), (9, "z")], latest=True).collect()} == {("2-ffff", True), ("2-0000", True), ("9-z", False)}


def test_long_ancestry(spark):
    rows = [("l", n, f"h{n}", n - 1 if n > 1 else None, f"h{n - 1}" if n > 1 else None, False, None, n) for n in range(1, 151)]
    revs = tree(spark, rows)
    assert R.ancestry(revs, R.leaves(revs)).count() == 150


def test_ancestry_is_whole_beyond_the_revision_limit(spark):
    rows = [("l", n, f"h{n}", n - 1 if n > 1 else None, f"h{n - 1}" if n > 1 else None, False, None, n) for n in range(1, R.REVS_LIMIT + 501)]
    revs = tree(spark, rows)
    got = R.ancestry(revs, R.leaves(revs)).orderBy("depth").collect()
    assert [r["num"] for r in got] == list(range(R.REVS_LIMIT + 500, 0, -1))
    assert R.paths(revs, R.leaves(revs)).first()["revisions"]["ids"] == [f"h{n}" for n in range(R.REVS_LIMIT + 500, 0, -1)]
    assert R.ancestry(revs, R.leaves(revs), 7).count() == 7
    old = R.open_revs(revs, "l", [(1, "h1")], latest=True).collect()
    assert [(r["rev"], r["ok"]) for r in old] == [(f"{R.REVS_LIMIT + 500}-h{R.REVS_LIMIT + 500}", True)]


def test_ancestry_of_a_circle_ends(spark):
    revs = tree(spark, [("c", 1, "a", 2, "b", False, None, 1), ("c", 2, "b", 1, "a", False, None, 2)])
    assert R.ancestry(revs, revs.where("num = 2")).count() == 2


def test_ancestry_query_of_long_trees_equals_sql(spark, tmp_path):
    from quillgrid.queries import ORACLES, QUERIES
    from tests.oracle import both

    spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("user_id", F.col("user_id") % 3).write.parquet(f"{tmp_path}/all")
    (part,) = (f for f in (tmp_path / "all").iterdir() if f.suffix == ".parquet")
    (tmp_path / "sf").mkdir()
    part.rename(tmp_path / "sf" / "events.parquet")
    mine, theirs = both(spark, QUERIES["ancestry"], ORACLES["ancestry"], str(tmp_path / "sf"))
    assert len(mine) > 3 * R.REVS_LIMIT
    assert mine == theirs


def test_diff(spark, forked):
    wanted = spark.createDataFrame([("d", 2, "ffff"), ("d", 3, "new"), ("g", 1, "n")], "id string, num int, hash string")
    got = {r["id"]: (r["missing"], r["possible_ancestors"]) for r in R.revs_diff(forked, wanted).collect()}
    assert got == {"d": (["3-new"], ["2-0000", "2-ffff"]), "g": (["1-n"], None)}


def test_purge_stem_and_prune(spark, forked):
    gone = R.purge(forked, spark.createDataFrame([("d", 2, "ffff"), ("f", 1, "p"), ("e", 1, "x")], "id string, num int, hash string"))
    assert {(r["id"], r["hash"]) for r in gone.collect()} == {("d", "a"), ("d", "0000"), ("e", "x"), ("e", "y")}
    assert R.winners(gone).where("id = 'd'").first()["hash"] == "0000"
    chain = tree(spark, [("c", n, f"h{n}", n - 1 or None, f"h{n - 1}" if n > 1 else None, False, "{}", n) for n in range(1, 6)])
    kept = R.stem(chain, 2)
    assert {(r["num"], r["body"]) for r in kept.collect()} == {(5, "{}"), (4, None)}
    assert {r["num"] for r in R.prune_history(chain, 3).collect()} == {3, 4, 5}


def test_partition_limit(spark):
    edits = spark.createDataFrame([(0, "p:a", 60), (1, "p:b", 60), (2, "p:c", 10), (3, "p:d", -50), (4, "q:a", 10)], "pos bigint, id string, growth bigint")
    got = {r["pos"]: r["accepted"] for r in write.limit_partitions(edits, spark.createDataFrame([("p", 0)], "part string, size bigint"), 100).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def test_interactive_writes(store):
    first = store.put({"_id": "a", "n": 1})
    assert first.startswith("1-")
    with pytest.raises(QueryError) as bad:
        store.put({"_id": "a", "n": 2})
    assert (bad.value.error, bad.value.status) == ("conflict", Conflict().status)
    second = store.put({"_id": "a", "_rev": first, "n": 2})
    assert second.startswith("2-") and store.get("a")["n"] == 2
    gone = store.delete("a", second)
    with pytest.raises(NotFound) as bad:
        store.get("a")
    assert bad.value.reason == "deleted" and gone.startswith("3-")
    assert store.put({"_id": "a", "n": 3}).startswith("4-")
    with pytest.raises(QueryError) as bad:
        store.delete("nope", "1-a")
    assert bad.value.status == 404


def test_bulk_order_sequences_and_validation(store):
    docs = [{"_id": f"d{i}", "n": i} for i in range(5)] + [{"_id": "d0", "n": 9}, {"_id": "_bad", "n": 1}, {"_id": "v", "forbid": True}]
    got = store.bulk(docs, lambda new, old: ("forbidden", "no") if new.get("forbid") else None).collect()
    assert [r["ok"] for r in got] == [True] * 5 + [False] * 3
    assert [r["error"] for r in got[5:]] == ["conflict", "illegal_docid", "forbidden"]
    assert [r["seq"] for r in store.revs().orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    info = store.info()
    assert info.pop("file_size") > 0
    assert info == {"db": "db", "doc_count": 5, "doc_del_count": 0, "update_seq": 5, "purge_seq": 0, "external_size": 5 * len('{"n":0}')}


def test_scans_find_and_changes(store):
    store.bulk([{"_id": x, "n": i} for i, x in enumerate(["alpha", "beta", "gamma", "delta"])] + [{"_id": "zeta"}])
    store.delete("zeta", store.get("zeta")["_rev"])
    page = store.all_docs(startkey="b", endkey="e", include_docs=True)
    assert [(r["id"], json.loads(r["doc"])["n"]) for r in page.rows.collect()] == [("beta", 1), ("delta", 3)]
    assert (page.total_rows(), page.offset()) == (4, 1)
    assert [r["id"] for r in store.all_docs(descending=True, startkey="gamma", endkey="beta", inclusive_end=False).rows.collect()] == ["gamma", "delta"]
    assert store.all_docs(startkey=["x"]).rows.count() == 0 and store.all_docs(startkey=None).rows.count() == 4
    keys = scan.all_docs_keys(store.winners(), ["zeta", "nope", "alpha", "alpha"]).rows.collect()
    assert [(r["key"], r["deleted"], r["error"]) for r in keys] == [("zeta", True, None), ("nope", None, "not_found"), ("alpha", None, None), ("alpha", None, None)]
    docs, bookmark = store.find({"selector": {"n": {"$gte": 1}}, "limit": 2, "sort": ["n"]}).page()
    assert [d["_id"] for d in docs] == ["beta", "gamma"]
    more, _ = store.find({"selector": {"n": {"$gte": 1}}, "limit": 2, "sort": ["n"], "bookmark": bookmark}).page()
    assert [d["_id"] for d in more] == ["delta"]
    feed = store.changes(ChangesQuery(since=2))
    assert [(r["seq"], r["id"], r["deleted"]) for r in feed.rows.collect()] == [(3, "gamma", False), (4, "delta", False), (6, "zeta", True)]
    assert (feed.last_seq(), feed.pending()) == (6, 0)
    some = store.changes(ChangesQuery(filter="_selector", selector={"n": {"$gt": 0}}, limit=1))
    assert [r["id"] for r in some.rows.collect()] == ["beta"] and some.last_seq() == 2 and some.pending() == 3
    assert [r["id"] for r in store.changes(ChangesQuery(filter=lambda doc, req: doc["n"] == 3)).rows.collect()] == ["delta"]
    assert store.changes(ChangesQuery(since="now")).rows.count() == 0
    assert [r["id"] for r in store.changes(ChangesQuery(doc_ids=["beta"], include_docs=True)).rows.collect()] == ["beta"]


def test_forced_revisions_and_replication(spark, tmp_path, store):
    ids = lambda *hashes: {"start": len(hashes), "ids": list(hashes)}
    store.force([{"_id": "doc1", "_revisions": ids("b" * 32, "a" * 32), "v": 1}, {"_id": "doc1", "_revisions": ids("c" * 32, "a" * 32), "v": 2}])
    store.force([{"_id": "doc1", "_revisions": ids("b" * 32, "a" * 32), "v": 1}])
    assert store.revs().count() == 3 and R.winners(store.revs()).first()["hash"] == "c" * 32
    store.bulk([{"_id": "x", "k": 1}, {"_id": "y", "k": 2}])
    other = Store(spark, f"file://{tmp_path}/other")
    stats, seq = replicate(store, other)
    assert (stats.missing_found, stats.docs_written) == (4, 4)
    rows = lambda s: {(r["id"], r["num"], r["hash"], r["parent_hash"]) for r in s.revs().collect()}
    assert rows(store) == rows(other)
    assert replicate(store, other)[0].missing_checked == 0
    rev = store.get("x")["_rev"]
    store.put({"_id": "x", "_rev": rev, "k": 5})
    assert replicate(store, other)[0].missing_found == 1 and other.get("x")["k"] == 5
    third = Store(spark, f"file://{tmp_path}/third")
    assert Scheduler().run("j", store, third, Options(selector={"k": {"$gt": 4}}))["docs_written"] == 1


def test_purge_compact_local_and_server(spark, tmp_path, store):
    rev = store.put({"_id": "a", "n": 1})
    second = store.put({"_id": "a", "_rev": rev, "n": 2})
    store.compact()
    assert {(r["num"], r["body"]) for r in store.revs().collect()} == {(1, None), (2, '{"n":2}')}
    store.purge({"a": [second]})
    assert store.all_docs().rows.count() == 0 or store.get("a")["_rev"] == rev
    store.put_local("_local/c", {"s": 1})
    store.put_local("_local/c", {"s": 2})
    assert store.get_local("_local/c") == {"s": 2}
    assert [r["rev"] for r in scan.local_docs(store.local()).collect()] == ["0-2"]
    server = Server(spark, f"file://{tmp_path}/server")
    server.create("one")
    server.create("two")
    server.drop("one")
    assert [r["name"] for r in server.all_dbs().collect()] == ["two"]
    assert [(r["db"], r["type"]) for r in server.events(1).collect()] == [("two", "created"), ("one", "deleted")]


def test_ids(spark):
    assert spark.range(3).select(write.new_id().alias("i")).where(F.length("i") == 32).count() == 3
    assert spark.range(3).select(write.new_id("utc_random").alias("i")).where(F.length("i") == 32).count() == 3
