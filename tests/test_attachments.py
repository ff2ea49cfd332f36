import base64
import hashlib

import pytest

from quillgrid.errors import NotFound, QueryError
from quillgrid.functions.revid import rev_hash
from quillgrid.operators.changes import ChangesQuery
from quillgrid.operators.replicate import replicate
from quillgrid.sources.store import Server, Store

TEXT = b"hello attachments " * 40
FILE = {"a.txt": {"content_type": "text/plain", "data": base64.b64encode(TEXT).decode()}, "b.bin": {"data": base64.b64encode(b"\x00\x01\x02\x03").decode()}}


@pytest.fixture()
def db(spark, tmp_path):
    return Server(spark, f"file://{tmp_path}").create("files")


def test_stubs_data_ranges_and_carry_over(db):
    first = db.put({"_id": "a", "n": 1, "_attachments": FILE})
    doc = db.get("a")
    assert set(doc["_attachments"]) == {"a.txt", "b.bin"} and all(x["stub"] and x["revpos"] == 1 for x in doc["_attachments"].values())
    assert doc["_attachments"]["a.txt"]["length"] == len(TEXT)
    assert db.attachment("a", "a.txt") == ("text/plain", TEXT) and db.attachment("a", "b.bin", start=1, end=2) == ("application/octet-stream", b"\x01\x02")
    files = [(n, x["content_type"], x["digest"]) for n, x in doc["_attachments"].items()]
    assert first == f"1-{rev_hash(False, None, '{\"n\":1}', files)}"
    second = db.put({**doc, "n": 2})  # stubs keep both
    assert db.get("a")["_attachments"]["a.txt"]["revpos"] == 1
    third = db.delete_attachment("a", "b.bin", second)
    fourth = db.put_attachment("a", "c.txt", b"new", "text/plain", third)
    got = db.get("a", attachments=True)["_attachments"]
    assert {n: base64.b64decode(x["data"]) for n, x in got.items()} == {"a.txt": TEXT, "c.txt": b"new"} and got["c.txt"]["revpos"] == 4
    db.put({"_id": "a", "_rev": fourth, "n": 5})  # none named: all go
    assert "_attachments" not in db.get("a")
    with pytest.raises(NotFound):
        db.attachment("a", "a.txt")
    assert db.attachment("a", "a.txt", fourth)[1] == TEXT  # the old revision has it until compaction
    db.compact()
    assert db.blobs().count() == 0


def test_bad_attachments(db):
    said = lambda a: db.bulk([{"_id": "x", "_attachments": a}]).first()["error"]
    assert said({"n": {"stub": True}}) == "missing_stub" and said({"n": {"data": "?"}}) == "bad_request" and said({"_n": {"data": ""}}) == "bad_request"
    with pytest.raises(QueryError) as bad:
        db.put({"_id": "y", "_attachments": {"n": {"stub": True}}})
    assert bad.value.status == 412


def test_copies_feeds_and_replicas_have_them(spark, tmp_path, db):
    db.bulk([{"_id": "a", "_attachments": FILE}, {"_id": "b", "n": 1}])
    db.copy("a", "c")
    assert db.attachment("c", "a.txt")[1] == TEXT and db.blobs().dropDuplicates(["digest"]).count() == 2
    feed = {r["id"]: r["attachments"] for r in db.changes(ChangesQuery(include_docs=True, attachments=True)).rows.collect()}
    assert '"data"' in feed["a"] and feed["b"] is None
    stubs = {r["id"]: r["attachments"] for r in db.changes(ChangesQuery(include_docs=True)).rows.collect()}
    assert '"stub":' in stubs["a"] and '"data"' not in stubs["a"]
    other = Store(spark, f"file://{tmp_path}/other")
    replicate(db, other)
    assert other.attachment("a", "a.txt")[1] == TEXT and other.get("a")["_rev"] == db.get("a")["_rev"] and other.blobs().count() == 2
    db.put({"_id": "d", "_attachments": FILE})
    replicate(db, other)
    assert other.blobs().count() == 2  # bytes that are there are not sent again
    other.force([{"_id": "e", "_revisions": {"start": 2, "ids": ["x", "w"]}, "_attachments": {"z": {"data": base64.b64encode(b"zed").decode()}}}])
    assert other.attachment("e", "z")[1] == b"zed" and hashlib.md5(b"zed").digest() == base64.b64decode(other.get("e")["_attachments"]["z"]["digest"][4:])
