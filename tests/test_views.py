import json

import pytest
from pyspark.sql import functions as F

from quillgrid.errors import QueryError
from quillgrid.operators import reduce as RD
from quillgrid.operators.views import Emit, View, ViewGroup, ViewQuery, build, emitted, linked_docs, refresh, rows

MIXED = {"d1": "apple", "d2": 10, "d3": None, "d4": ["a"], "d5": True, "d6": {"o": 1}, "d7": "Apple", "d8": 2, "d9": False}


def by_key(doc, emit):
    emit(doc["k"], doc.get("v"))


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame([(i, n, json.dumps({"k": k})) for n, (i, k) in enumerate(MIXED.items())], "id string, seq bigint, doc string")
    return build(docs, View(map=by_key))


@pytest.fixture(scope="module")
def numbers(spark):
    docs = spark.createDataFrame([(f"doc{i}", i, i, "odd" if i % 2 else "even") for i in range(1, 6)], "id string, seq bigint, n int, tag string").cache()
    return docs


def ids(page):
    return [r["id"] for r in page.rows.collect()]


def test_mixed_keys_collate(mixed):
    assert ids(rows(mixed, ViewQuery())) == ["d3", "d9", "d5", "d8", "d2", "d1", "d7", "d4", "d6"]
    assert ids(rows(mixed, ViewQuery(descending=True)))[0] == "d6"
    assert ids(rows(mixed, ViewQuery(startkey=5, endkey="b"))) == ["d2", "d1", "d7"]
    assert ids(rows(mixed, ViewQuery(key=None))) == ["d3"]
    assert ids(rows(mixed, ViewQuery(keys=["Apple", 2, "Apple"]))) == ["d7", "d8", "d7"]


def test_range_offset_total(numbers):
    index = build(numbers, View([Emit(F.col("n"), F.col("tag"))]))
    page = rows(index, ViewQuery(startkey=2, endkey=4, skip=1, limit=1))
    assert (ids(page), page.total_rows(), page.offset()) == (["doc3"], 5, 2)
    assert ids(rows(index, ViewQuery(startkey=4, endkey=2, descending=True, inclusive_end=False))) == ["doc4", "doc3"]
    assert rows(index, ViewQuery(startkey=99)).offset() == 5


def test_several_emissions_and_conditions(numbers):
    index = build(numbers, View([Emit(F.col("n"), when=F.col("tag") == "odd"), Emit(F.col("n") * 10)]))
    assert [(r["k0"], r["id"]) for r in rows(index, ViewQuery(endkey=10)).rows.collect()] == [(1, "doc1"), (3, "doc3"), (5, "doc5"), (10, "doc1")]


@pytest.mark.parametrize(
    ("reducer", "wanted"),
    [
        ("_count", 5),
        ("_sum", 15.0),
        ("_sumorama", 15.0),
        ("_approx_count_distinct", 2),
        ("_first", 2),
        ("_last", 5),
        ("_top_2", [5, 4]),
        ("_bottom_2", [1, 2]),
    ],
)
def test_builtin_whole_range(numbers, reducer, wanted):
    index = build(numbers, View([Emit(F.col("tag"), F.col("n"))], reduce=reducer))
    assert [r["value"] for r in RD.reduce_rows(index, ViewQuery()).collect()] == [wanted]


def test_stats_groups_and_empty_ranges(numbers):
    index = build(numbers, View([Emit(F.col("tag"), -F.col("n"))], reduce="_stats"))
    got = {r["k0"]: r["value"].asDict() for r in RD.reduce_rows(index, ViewQuery(group=True)).collect()}
    assert got["even"] == {"sum": -6.0, "count": 2, "min": -4.0, "max": -2.0, "sumsqr": 20.0}
    assert RD.reduce_rows(index, ViewQuery(startkey="zzz")).collect() == []


def test_json_reductions(spark):
    docs = [("a", {"k": ["x", 1], "v": [1, 2]}), ("b", {"k": ["x", 2], "v": [10]}), ("c", {"k": ["y", 1], "v": 5}), ("d", {"k": "z", "v": 7})]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id string, doc string")
    index = build(frame, View(map=by_key, reduce="_sum"))
    got = [(r["key_json"], r["value"]) for r in RD.reduce_rows(index, ViewQuery(group_level=1)).collect()]
    assert got == [('"z"', "7"), ('["x"]', "[11.0,2.0]"), ('["y"]', "5")]
    index.reduce = "_count"
    assert [(r["key_json"], r["value"]) for r in RD.reduce_rows(index, ViewQuery(group_level=0)).collect()] == [('"z"', 1), ("[]", 3)]
    index.reduce = "_stats"
    with pytest.raises(Exception, match="builtin_reduce_error"):
        RD.reduce_rows(index, ViewQuery()).collect()


def test_user_reduce_in_two_phases(spark):
    docs = spark.createDataFrame([(f"d{i:05d}", i % 3, i) for i in range(5000)], "id string, g int, n int")

    def total(keys, values, again):
        assert again == (keys is None)
        return sum(values)

    index = build(docs, View([Emit(F.col("g"), F.col("n"))], reduce=total))
    assert {r["k0"]: int(r["value"]) for r in RD.reduce_rows(index, ViewQuery(group=True)).collect()} == {g: sum(range(g, 5000, 3)) for g in range(3)}
    index.reduce = lambda keys, values, again: ["x" * 300]
    small = build(docs.limit(3), View([Emit(F.col("g"), F.col("n"))], reduce=index.reduce))
    assert {r["error"] for r in RD.reduce_rows(small, ViewQuery()).collect()} == {"reduce_overflow_error"}


def test_map_errors_stay_with_their_document():
    def picky(doc, emit):
        emit(1 / doc["n"], None)

    assert emitted(picky, '{"n":0}') == [] and emitted(picky, '{"n":2}') == [(0.5, "0.5", "null")]


@pytest.mark.parametrize(
    ("q", "reducer"),
    [
        (ViewQuery(reduce=True), None),
        (ViewQuery(group=True), None),
        (ViewQuery(include_docs=True), "_count"),
        (ViewQuery(keys=[1], key=1), None),
        (ViewQuery(keys=[1, 2]), "_count"),
        (ViewQuery(startkey=3, endkey=1), None),
        (ViewQuery(partition="p"), None),
    ],
)
def test_argument_checks(q, reducer):
    with pytest.raises(QueryError):
        q.check(reducer)


def test_parameters_merge():
    q = ViewQuery.of({"start_key": 1, "limit": 5}, limit=2, stale="ok")
    assert (q.startkey, q.limit, q.update) == (1, 2, "false")


@pytest.mark.parametrize("name", ["_top_0", "_top_101", "_nope"])
def test_unknown_reducers(name):
    with pytest.raises(QueryError):
        RD.builtin_name(name)


def test_signatures_and_refresh(numbers):
    one = ViewGroup({"v": View([Emit(F.col("n"))])})
    assert one.signature() == ViewGroup({"v": View([Emit(F.col("n"))])}).signature() != ViewGroup({"v": View([Emit(F.col("tag"))])}).signature()
    old = build(numbers, View([Emit(F.col("n"))])).rows
    changed = numbers.where("n <= 2").withColumn("n", F.col("n") + 100)
    new = refresh(old, changed, build(changed, View([Emit(F.col("n"))])).rows)
    assert sorted(r["k0"] for r in new.collect()) == [3, 4, 5, 101, 102]


def test_linked_documents(spark):
    winners = spark.createDataFrame([("a", 1, "h", False, "A"), ("b", 1, "h", True, "B")], "id string, num int, hash string, deleted boolean, doc string")
    got = spark.createDataFrame([("x", '{"_id":"a"}'), ("a", "null"), ("y", '{"_id":"b"}')], "id string, value_json string")
    assert {(r["id"], r["doc"]) for r in linked_docs(got, winners).collect()} == {("x", "A"), ("a", "A"), ("y", None)}


def test_partitioned_view(spark):
    docs = spark.createDataFrame([("p1:a", 1), ("p1:b", 2), ("p2:a", 9)], "id string, n int")
    index = build(docs, View([Emit(F.col("n"))], reduce="_count"), part=F.substring_index("id", ":", 1))
    assert [r["value"] for r in RD.reduce_rows(index, ViewQuery(partition="p1")).collect()] == [2]
    assert ids(rows(index, ViewQuery(partition="p2", reduce=False))) == ["p2:a"]
