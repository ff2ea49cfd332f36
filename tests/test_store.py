"""Sequences, purges, feeds, indexes and views of a store over time."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from quillgrid.errors import QueryError
from quillgrid.operators import revisions as R
from quillgrid.operators import scan, views
from quillgrid.operators.changes import ChangesQuery, design_seq
from quillgrid.operators.designdocs import DesignDoc, ViewCatalog, validators
from quillgrid.operators.find import explain
from quillgrid.operators.replicate import Options, Scheduler, replicate
from quillgrid.operators.views import Emit, View, ViewQuery, build
from quillgrid.sources.folder import Folder
from quillgrid.sources.indextable import MOST, IndexTable
from quillgrid.sources.store import Store
from quillgrid.streaming import feeds


def by_n(doc, emit):
    emit(doc["n"], None)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db")


def feed(store, **q):
    return [(r["seq"], r["id"]) for r in store.changes(ChangesQuery(**q)).rows.collect()]


def test_numbers_are_given_out_once(spark, tmp_path, store):
    store.bulk([{"_id": f"d{i}", "n": i} for i in range(4)])
    catalog = ViewCatalog(store, f"file://{tmp_path}/views")
    catalog.register(DesignDoc("dd", views={"v": View(map=by_n)}))
    ids = lambda: [r["id"] for r in catalog.query("dd", "v").rows.collect()]
    other = Store(spark, f"file://{tmp_path}/other")
    assert ids() == ["d0", "d1", "d2", "d3"] and replicate(store, other)[1] == 4
    gone = store.purge({"d3": [store.get("d3")["_rev"]], "nope": ["1-x"]})
    assert [(r["id"], r["num"], r["purge"]) for r in gone.collect()] == [("d3", 1, 1)]
    assert (store.last_seq(), store.purge_seq(), store.info()["purge_seq"]) == (4, 1, 1)
    store.put({"_id": "new", "n": 9})
    assert feed(store, since=4) == [(5, "new")] and store.changes(ChangesQuery(since="now")).since == 5
    assert ids() == ["d0", "d1", "d2", "new"]
    replicate(store, other)
    assert other.get("new")["n"] == 9
    assert store.purge({"d0": ["1-unknown"]}).count() == 0 and store.purge_seq() == 1
    assert Store(spark, store.folder.path).last_seq() == 5


def test_a_purge_brings_a_losing_branch_back(spark, tmp_path, store):
    first = store.put({"_id": "a", "n": 1})
    store.force([{"_id": "a", "_revisions": {"start": 2, "ids": [h, first[2:]]}, "n": n} for h, n in (("bb", 2), ("aa", 3))])
    catalog = ViewCatalog(store, f"file://{tmp_path}/views")
    catalog.register(DesignDoc("dd", views={"v": View(map=by_n)}))
    keys = lambda: [r["key_json"] for r in catalog.query("dd", "v").rows.collect()]
    assert keys() == ["2"]
    assert [r["hash"] for r in store.purge({"a": ["2-bb", first]}).collect()] == ["bb"]
    assert keys() == ["3"] and catalog.info("dd")["purge_seq"] == 1 and catalog.info("dd")["sizes"]["active"] > 0
    store.compact()
    store.put({"_id": "b", "n": 7})
    assert keys() == ["3", "7"] and [r["seq"] for r in store.changes().rows.collect()] == [2, 3]
    assert store.purge({"a": ["2-aa"]}).count() == 2 and keys() == ["7"]  # and what only it had


def test_feeds_and_view_rows_keep_their_order_after_joins(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.bulk([{"_id": f"d{(i * 37) % 60:02d}", "n": (i * 11) % 60} for i in range(60)])
        r = store.get("d07")
        store.force([{"_id": "d07", "_revisions": {"start": 2, "ids": [h, r["_rev"][2:]]}, "n": 100 + i} for i, h in enumerate(("aa", "bb"))])
        for q in ({"style": "all_docs"}, {"include_docs": True, "conflicts": True}, {"include_docs": True, "style": "all_docs", "descending": True}, {"include_docs": True, "limit": 20}):
            rows = store.changes(ChangesQuery(**q)).rows.collect()
            seqs = [x["seq"] for x in rows]
            assert seqs == sorted(seqs, reverse=q.get("descending", False)) and len(seqs) == q.get("limit", 60)
        last = store.changes(ChangesQuery(style="all_docs", include_docs=True, conflicts=True)).rows.collect()[-1]
        assert (last["id"], last["changes"], last["conflicts"], json.loads(last["doc"])) == ("d07", ["2-bb", "2-aa"], ["2-aa"], {"n": 101})
        docs = store.winners(True).where("not deleted").select("id", "seq", F.get_json_object("body", "$.n").cast("int").alias("n"))
        index = build(docs, View([Emit(F.col("n"))]))
        for q in ({}, {"descending": True}, {"skip": 3, "limit": 9}, {"keys": [50, 3, 50]}):
            plain = [(x["k0"], x["id"]) for x in views.rows(index, ViewQuery(**q)).rows.collect()]
            whole = views.rows(index, ViewQuery(**q, include_docs=True, conflicts=True), store.winners(), store.revs()).rows.collect()
            assert [(x["k0"], x["id"]) for x in whole] == plain and all(json.loads(x["doc"])["n"] == x["k0"] for x in whole)
        assert {x["id"]: x["conflicts"] for x in whole}.get("d07") is None
        top = views.rows(index, ViewQuery(startkey=100, include_docs=True, conflicts=True), store.winners(), store.revs()).rows.collect()
        assert [x["conflicts"] for x in top] == [["2-aa"]]
        pages = views.batches(index, [ViewQuery(limit=1), ViewQuery(descending=True, limit=2)])
        assert [p.rows.count() for p in pages] == [1, 2] and [p.offset() for p in pages] == [0, 0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_winners_read_no_bodies(spark, store):
    store.bulk([{"_id": "a", "n": 1}])
    plan = store.winners()._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "atts" not in plan and plan.count("Exchange") == 1
    assert "body" not in store.changes().rows._jdf.queryExecution().executedPlan().toString()


def test_streams_go_on_over_purges_and_compaction_and_see_winners(spark, tmp_path, store):
    at, view = f"file://{tmp_path}", View(map=by_n)

    def drain():
        feeds.run_once(feeds.log_stream(store), feeds.incremental_view(store, f"{at}/view", view), f"{at}/c1")
        feeds.run_once(feeds.log_stream(store), feeds.lines_sink(store, f"{at}/lines"), f"{at}/c2")
        rows = IndexTable(spark, f"{at}/view").read()
        return sorted((r["id"], r["key_json"]) for r in rows.collect())

    assert feeds.log_stream(store).isStreaming
    store.bulk([{"_id": f"d{i}", "n": i} for i in range(3)])
    assert drain() == [("d0", "0"), ("d1", "1"), ("d2", "2")]
    store.compact()
    store.purge({"d2": [store.get("d2")["_rev"]]})
    first = store.get("d0")["_rev"]
    store.put({"_id": "d3", "n": 3})
    assert drain() == [("d0", "0"), ("d1", "1"), ("d3", "3")]
    store.force([{"_id": "d0", "_revisions": {"start": 2, "ids": [h, first[2:]]}, "n": n} for h, n in (("bb", 20), ("aa", 10))])
    assert drain() == [("d0", "20"), ("d1", "1"), ("d3", "3")]
    lines = spark.read.json(f"{at}/lines")
    assert lines.where("id = 'd0'").orderBy(F.desc("seq")).first()["changes"] == ["2-bb"]
    store.vacuum()
    assert store.winners().count() == 3


def test_longpoll_waits_for_a_change_that_passes(store):
    from threading import Timer

    store.bulk([{"_id": "a", "n": 1}])
    began = time.monotonic()
    timer = Timer(1.0, lambda: store.bulk([{"_id": "b", "n": 2}, {"_id": "c", "n": 3}]))
    timer.start()
    found = feeds.longpoll(store, ChangesQuery(since="now", filter="_selector", selector={"n": 3}), timeout=60)
    timer.join()
    assert [r["id"] for r in found.rows.collect()] == ["c"] and time.monotonic() - began < 50
    assert feeds.longpoll(store, ChangesQuery(since=found.last_seq()), timeout=0.3).rows.count() == 0


def test_index_tables_replace_by_document_and_become_one(spark, tmp_path):
    table = IndexTable(spark, f"file://{tmp_path}/t")
    rows = lambda pairs: views.build_json(spark.createDataFrame([(i, 0, json.dumps({"n": n})) for i, n in pairs], "id string, seq bigint, doc string"), View(map=by_n)).rows
    have = {f"d{i}": i for i in range(20)}
    table.update(None, rows(have.items()), 1)
    for n in range(2, MOST + 6):
        have |= {"d1": 100 + n, f"x{n}": [n]}
        have.pop(f"d{n}", None)
        changed = spark.createDataFrame([("d1",), (f"x{n}",), (f"d{n}",)], "id string")
        table.update(changed, rows([("d1", 100 + n), (f"x{n}", [n])]), n, n)
    assert {r["id"]: json.loads(r["key_json"]) for r in table.read().collect()} == have and table.reached() == (n, n)
    assert len(table._live()) <= MOST + 1
    index = views.Index(table.read())
    got = lambda **q: [r["id"] for r in views.rows(index, ViewQuery(**q)).rows.collect()]
    order = sorted(have.items(), key=lambda x: (isinstance(x[1], list), x[1]))
    ids = lambda test: [i for i, v in order if test(v)]
    number = lambda v: not isinstance(v, list)
    assert got(startkey=15) == ids(lambda v: not number(v) or v >= 15) and got(endkey=15) == ids(lambda v: number(v) and v <= 15)
    assert got(startkey=[4], endkey=[7]) == ids(lambda v: not number(v) and [4] <= v <= [7])
    assert got(key=[5]) == ["x5"] and got(keys=[19, [3]]) == ["d19", "x3"] and got(startkey="a") == ids(lambda v: not number(v))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = views.rows(index, ViewQuery(startkey=15, endkey=16)).rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(number,15.0)" in plan


def test_store_indexes_are_used_and_follow_writes_and_purges(spark, store):
    store.bulk([{"_id": f"d{i:02d}", "type": "ab"[i % 2], "n": i, **({"k": i} if i % 3 else {})} for i in range(30)])
    request = {"selector": {"type": "a", "n": {"$gte": 10, "$lt": 20}}, "sort": ["type", "n"], "limit": 50}
    scanned = store.find({**request, "sort": []})
    assert scanned.index is None
    assert store.indexes.create(["type", "n"], "tn", "dd") == "created" and store.indexes.create(["type", "n"], "tn", "dd") == "exists"
    ids = lambda f: [d["_id"] for d in f.page()[0]]
    found = store.find(request)
    assert found.index.name == "tn" and ids(found) == sorted(ids(scanned)) == ["d10", "d12", "d14", "d16", "d18"]
    assert 'EqualTo(k_rank,5)' in found.docs._jdf.queryExecution().executedPlan().toString() or "k_rank" in found.docs._jdf.queryExecution().executedPlan().toString()
    doc = store.get("d12")
    store.put({**doc, "n": 99})
    store.delete("d14", store.get("d14")["_rev"])
    store.put({"_id": "zz", "type": "a", "n": 11.5})
    assert ids(store.find(request)) == ["d10", "zz", "d16", "d18"]
    store.purge({"d16": [store.get("d16")["_rev"]]})
    assert ids(store.find(request)) == ["d10", "zz", "d18"]
    store.indexes.create(["k"], "ks", "pp", partial={"type": "b"})
    assert ids(store.find({"selector": {"k": {"$gt": 24}}, "use_index": "pp/ks"})) == ["d25", "d29"]
    assert store.find({"selector": {"k": {"$gt": 24}}}).index is None
    again = Store(spark, store.folder.path)
    assert [x["name"] for x in again.indexes.list()] == ["_all_docs", "tn", "ks"] and ids(again.find(request)) == ["d10", "zz", "d18"]
    said = explain(store.live(), {"selector": {"type": "a", "n": 11.5}}, store.indexes, body="body")
    assert said["index"]["name"] == "tn" and said["range"]["start_key"] == ["a", 11.5]
    assert ids(store.find({"selector": {"type": "b", "n": {"$gt": None}}, "sort": [{"type": "desc"}, {"n": "desc"}], "limit": 2})) == ["d29", "d27"]
    store.indexes.delete("_design/pp", "ks")
    assert [x["name"] for x in store.indexes.list()] == ["_all_docs", "tn"]


def test_maps_see_conflicts_and_stubs(spark, tmp_path, store):
    store.put({"_id": "a", "n": 1, "_attachments": {"x": {"data": "aGk="}}})
    r = store.get("a")["_rev"][2:]
    store.force([{"_id": "a", "_revisions": {"start": 2, "ids": [h, r]}, "n": n} for h, n in (("bb", 2), ("aa", 3))])
    store.put({"_id": "e"})

    def all_of(doc, emit):
        emit([doc["_id"], doc.get("_conflicts"), sorted(doc.get("_attachments", {}))], doc.get("n"))

    catalog = ViewCatalog(store, f"file://{tmp_path}/views")
    catalog.register(DesignDoc("dd", views={"v": View(map=all_of)}))
    assert [r["key_json"] for r in catalog.query("dd", "v").rows.collect()] == ['["a", ["2-aa"], []]', '["e", null, []]']
    store.put({"_id": "f", "_attachments": {"y": {"data": "aGk="}}})
    pages = catalog.queries("dd", "v", [ViewQuery(startkey=["f"]), ViewQuery(limit=1)])
    assert [[r["key_json"] for r in p.rows.collect()] for p in pages] == [['["f", null, ["y"]]'], ['["a", ["2-aa"], []]']]
    got = catalog.query("dd", "v", ViewQuery(include_docs=True, attachments=True, conflicts=True)).rows.collect()
    assert [r["id"] for r in got] == ["a", "e", "f"] and '"data":"aGk="' in got[2]["attachments"] and got[0]["conflicts"] == ["2-aa"]


def test_signatures_hold_in_every_process():
    make = lambda n: View(map=lambda doc, emit: [emit(x + n, None) for x in doc["xs"]])
    one, same, other = (views.ViewGroup({"v": make(n)}).signature() for n in (1, 1, 2))
    assert one == same != other and not re.search("0x[0-9a-f]{6}", str(views.code_said(make(1).map)))


def test_limits_on_write(spark, tmp_path):
    db = Store(spark, f"file://{tmp_path}/p", partitioned=True, partition_limit=40)
    body = {"t": "x" * 20}
    got = db.bulk([{"_id": f"p:{i}", **body} for i in range(4)] + [{"_id": "q:1", **body}]).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, True] and {r["error"] for r in got[2:4]} == {"forbidden"}
    with pytest.raises(QueryError) as bad:
        db.put({"_id": "p:9", **body})
    assert bad.value.status == 403 and [r["id"] for r in db.all_docs().rows.collect()] == ["p:0", "p:1", "q:1"]
    db.delete("p:0", db.get("p:0")["_rev"])
    assert db.put({"_id": "p:8", "n": 1})
    short = Store(spark, f"file://{tmp_path}/s", revs_limit=3)
    rev = None
    for n in range(5):
        rev = short.put({"_id": "a", "_rev": rev, "n": n})
    assert {r["num"] for r in short.revs().collect()} == {3, 4, 5} and short.last_seq() == 5


def test_replication_in_batches_with_failures_and_forever(spark, tmp_path, store):
    store.bulk([{"_id": f"d{i:02d}", "n": i} for i in range(25)])
    other = Store(spark, f"file://{tmp_path}/other")
    refuse = validators([DesignDoc("v", validate=lambda new, old: ("forbidden", "odd") if new["n"] % 2 else None)])
    stats, seq = replicate(store, other, batch=10, validate=refuse)
    assert (seq, stats.docs_read, stats.docs_written, stats.doc_write_failures) == (25, 25, 13, 12)
    assert other.get_local(next(iter(r["id"] for r in other.local().collect())))["doc_write_failures"] == 12
    third = Store(spark, f"file://{tmp_path}/third")
    jobs = Scheduler(f"file://{tmp_path}/jobs")
    assert jobs.run("live", store, third, Options(continuous=True))["state"] == "running"
    try:
        jobs.streams["live"].processAllAvailable()
        assert third.winners().count() == 25
        store.put({"_id": "late", "n": 1})
        jobs.streams["live"].processAllAvailable()
        assert third.get("late")["n"] == 1 and jobs.state("live") == "running"
    finally:
        jobs.stop("live")
    assert jobs.state("live") == "stopped"
    assert Scheduler().run("x", store, third, Options(continuous=True))["state"] == "failed"


def test_bulk_get_and_open_revs_with_ancestry(spark, store):
    first = store.put({"_id": "a", "n": 1, "_attachments": {"x": {"data": "aGk="}}})
    second = store.put({"_id": "a", "_rev": first, "n": 2, "_attachments": {"x": {"stub": True}}})
    wanted = spark.createDataFrame([(0, "a", None, None), (1, "a", 1, first[2:]), (2, "z", None, None)], "pos int, id string, num int, hash string")
    got = {r["pos"]: r for r in store.bulk_get(wanted, revisions=True, attachments=True).collect()}
    assert (got[0]["rev"], got[0]["revisions"]["start"], got[0]["revisions"]["ids"]) == (second, 2, [second[2:], first[2:]])
    assert got[1]["revisions"]["ids"] == [first[2:]] and '"data":"aGk="' in got[0]["atts"] and got[2]["error"]["reason"] == "missing"
    opened = R.open_revs(store.revs(), "a", with_path=True).collect()
    assert [(r["rev"], r["revisions"]["ids"]) for r in opened] == [(second, [second[2:], first[2:]])]
    assert store.get("a", first)["n"] == 1 and design_seq(store.winners()) == 0
    store.put({"_id": "_design/x", "n": 1})
    assert design_seq(store.winners()) == 3
    assert scan.batches(store.winners(), [{"keys": ["a"]}, {"startkey": "b"}])[0].rows.count() == 1


def test_ids_of_every_kind(spark):
    from quillgrid.operators.write import new_id

    rows = [r["i"] for r in spark.range(50).select(new_id("sequential").alias("i")).collect()]
    assert len({r[:16] for r in rows}) == 1 and len(set(rows)) == 50 and rows == sorted(rows) and all(len(r) == 32 for r in rows)
    assert spark.range(1).select(new_id("utc_id", "-here").alias("i")).first()["i"].endswith("-here")
    with pytest.raises(QueryError):
        new_id("other")


def test_a_run_of_many_batches_works_its_documents_out_once(spark, tmp_path, monkeypatch):
    from quillgrid.operators import replicate as RP

    source, target = (Store(spark, f"file://{tmp_path}/{n}") for n in ("from", "to"))
    source.bulk([{"_id": f"d{i}", "v": i} for i in range(7)])
    calls, paths = [], RP.R.paths
    monkeypatch.setattr(RP.R, "paths", lambda *a: calls.append(a) or paths(*a))
    stats, seq = RP.replicate(source, target, batch=2)
    assert (stats.docs_written, stats.missing_checked, seq, len(target.commits())) == (7, 7, 7, 4)
    assert len(calls) == 1
    same = lambda s: sorted(s.winners(True).drop("seq").collect())
    assert same(target) == same(source)
    source.bulk([{"_id": "new", "v": 8}])
    assert RP.replicate(source, target, batch=2)[0].docs_written == 1 and target.get("new")["v"] == 8
    assert RP.replicate(source, target)[0].missing_checked == 0


def test_batches_of_a_replication_take_no_jobs_of_their_own(spark, tmp_path):
    source = Store(spark, f"file://{tmp_path}/from")
    source.bulk([{"_id": f"d{i:02d}", "v": i} for i in range(24)])

    def jobs(batch):
        target, group = Store(spark, f"file://{tmp_path}/to{batch}"), f"{tmp_path}-{batch}"
        spark.sparkContext.setJobGroup(group, "")
        try:
            assert replicate(source, target, batch=batch)[0].docs_written == 24
            n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setJobGroup("", "")
        rows = sorted(target.winners(True).select("seq", "id", "num", "hash", "deleted", "body").collect())
        assert [(r["seq"], r["id"]) for r in rows] == [(i + 1, f"d{i:02d}") for i in range(24)]
        assert len(target.commits()) == -(-24 // batch) and target.last_seq() == 24
        return n, [r[1:] for r in rows]

    (few, whole), (many, parts) = jobs(24), jobs(2)
    assert parts == whole and many <= few + 4


def test_a_target_that_others_write_between_batches_keeps_both(spark, tmp_path, monkeypatch):
    source, target = (Store(spark, f"file://{tmp_path}/{n}") for n in ("from", "to"))
    source.bulk([{"_id": f"d{i}", "v": i} for i in range(6)])
    put, told = Store.put_local, []

    def meddle(self, *a):
        put(self, *a)
        if self is target and not told:
            told.append(self.bulk([{"_id": "own", "v": 0}]))
            self.force([{"_id": "d5", "_revisions": {"start": 1, "ids": [next(r["hash"] for r in source.revs().collect() if r["id"] == "d5")]}, "v": 5}])

    monkeypatch.setattr(Store, "put_local", meddle)
    stats, seq = replicate(source, target, batch=2)
    assert (seq, stats.missing_checked, stats.docs_written) == (6, 6, 5)
    rows = target.revs().collect()
    assert sorted(r["id"] for r in rows) == [*(f"d{i}" for i in range(6)), "own"]
    assert sorted(r["seq"] for r in rows) == list(range(1, 8)) and target.last_seq() == 7


def test_a_failed_replication_goes_on_at_its_checkpoint(spark, tmp_path, monkeypatch):
    source, target = (Store(spark, f"file://{tmp_path}/{n}") for n in ("from", "to"))
    source.bulk([{"_id": f"d{i}", "v": i, "_attachments": {"x": {"data": "aGk="}}} for i in range(6)])
    adopt, done = Store.adopt, []
    monkeypatch.setattr(Store, "adopt", lambda self, *a: done.append(a) or (adopt(self, *a) if len(done) < 3 else 1 / 0))
    with pytest.raises(ZeroDivisionError):
        replicate(source, target, batch=2)
    monkeypatch.undo()
    assert target.winners().count() == 4
    stats, seq = replicate(source, target, batch=2)
    assert (seq, stats.missing_checked, stats.docs_written, target.winners().count()) == (6, 2, 2, 6)
    assert target.attachment("d5", "x")[1] == b"hi" and target.blobs().count() == 1


def test_local_documents_are_put_without_jobs_and_written_together_at_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillgrid.sources.store.MOST", 3)
    store = Store(spark, f"file://{tmp_path}/db")
    for i in range(11):
        store.put_local("_local/a", {"s": i})
        if i % 4 == 0:
            store.put_local("_local/b", {"t": 'é "quoted"\n', "s": i})
    assert store.get_local("_local/a") == {"s": 10} and store.get_local("_local/b") == {"t": 'é "quoted"\n', "s": 8}
    assert sorted((r["id"], r["n"]) for r in store.local().collect()) == [("_local/a", 11), ("_local/b", 3)]
    assert len(store.folder.at("local").parts()) <= 7
    odd = Folder(spark, f"file://{tmp_path}/odd [x]{{y}}*?")
    assert odd.parts() == [] and odd.put("", "x", n=1, seq=2) and odd.parts() == [{"n": 1, "seq": 2, "path": "n=1.seq=2"}]
