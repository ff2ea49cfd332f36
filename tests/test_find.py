import base64
import json

import pytest
from pyspark.sql import functions as F

from quillgrid.errors import NotFound, QueryError
from quillgrid.operators import attachments as A
from quillgrid.operators.find import Find, IndexCatalog, explain, find, with_stats


@pytest.fixture(scope="module")
def people(spark):
    rows = [("u1", "user", "alice", 31, ["admin", "dev"], None), ("u2", "user", "bob", 25, ["dev"], None), ("u3", "user", "carol", 40, None, None), ("p1", "post", "hello", None, None, "alice"), ("p2", "post", "world", None, None, "bob")]
    return spark.createDataFrame(rows, "_id string, type string, name string, age bigint, tags array<string>, author string").cache()


def got(found):
    return [r["_id"] for r in found.docs.collect()]


def test_sort_drops_documents_without_the_field(people):
    assert got(find(people, Find({}, sort=["age"]))) == ["u2", "u1", "u3"]
    assert got(find(people, Find({}, sort=[{"_id": "desc"}], limit=2))) == ["u3", "u2"]


def test_bookmarks_walk_all_pages(people):
    seen, mark = [], None
    while True:
        docs, mark = find(people, Find({"type": "user"}, sort=["age"], limit=2, bookmark=mark)).page()
        if not docs:
            break
        seen += [d["_id"] for d in docs]
    assert seen == ["u2", "u1", "u3"]
    with pytest.raises(QueryError):
        find(people, Find({}, bookmark="!!"))


def test_request_checks(people):
    with pytest.raises(QueryError) as bad:
        Find({}, sort=[{"a": "asc"}, {"b": "desc"}])
    assert bad.value.error == "unsupported_mixed_sort"
    with pytest.raises(QueryError) as bad:
        find(people, Find({}, sort=["age"], strict=True))
    assert bad.value.error == "no_usable_index"


def test_indexes(people, tmp_path):
    catalog = IndexCatalog(f"file://{tmp_path}/indexes")
    assert catalog.create(people, ["age"], "by-age", "dd") == "created"
    assert catalog.create(people, ["age"], "by-age", "dd") == "exists"
    assert catalog.create(people, ["name"], "users", "dd", partial={"type": "user"}) == "created"
    found = find(people, Find({"age": {"$gt": 30}}, sort=["age"], strict=True), catalog=catalog)
    assert got(found) == ["u1", "u3"] and found.index.name == "by-age" and found.warning is None
    assert find(people, Find({"name": {"$gt": "a"}}), catalog=catalog).index is None
    assert got(find(people, Find({"name": {"$gt": "a"}}, use_index="dd/users"), catalog=catalog)) == ["u1", "u2", "u3"]
    assert "not used" in find(people, Find({"type": "user"}, use_index="dd/by-age"), catalog=catalog).warning
    assert [x["name"] for x in catalog.list()] == ["_all_docs", "by-age", "users"]
    said = explain(people, Find({"age": {"$gte": 30, "$lt": 40}}), catalog)
    assert said["index"]["name"] == "by-age" and said["range"] == {"start_key": [30], "end_key": [40]}
    catalog.delete("_design/dd", "users")
    with pytest.raises(NotFound):
        catalog.delete("dd", "users")
    with pytest.raises(QueryError):
        catalog.create(people, ["x"], kind="text")


def test_stats(people):
    docs, returned, examined = with_stats(find(people, Find({"type": "post"}, execution_stats=True)))
    docs.collect()
    assert returned.get["results_returned"] == 2 and examined.get["total_docs_examined"] == 5


def test_attachments(spark):
    text = b"hello " * 100
    rows = spark.createDataFrame([("a", 2, "h", "t.txt", "text/plain", bytearray(text)), ("a", 2, "h", "b.bin", "image/png", bytearray(b"\x00\x01\x02\x03"))], "id string, num int, hash string, name string, content_type string, data binary")
    stored = A.put(rows).cache()
    by_name = {r["name"]: r for r in stored.collect()}
    assert by_name["t.txt"]["encoding"] == "gzip" and len(by_name["t.txt"]["data"]) < 100 and by_name["t.txt"]["length"] == 600
    revs = A.stubs(stored)
    blobs = stored.select("digest", "encoding", "data")
    assert bytes(A.get(revs, blobs, "a", 2, "h", "t.txt").first()["data"]) == text
    assert bytes(A.get(revs, blobs, "a", 2, "h", "b.bin", 1, 2).first()["data"]) == b"\x01\x02"
    old, new = (json.loads(A.with_data(revs, blobs, since).first()["atts"]) for since in (2, 1))
    assert list(old) == ["b.bin", "t.txt"] and all(a["stub"] and "data" not in a for a in old.values())
    assert base64.b64decode(new["t.txt"]["data"]) == text and "stub" not in new["t.txt"]
