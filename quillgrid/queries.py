"""Registered queries over the driver's tables, each with the DuckDB SQL it is held against.

A table's rows are documents: ``events`` by event_id (which is also its sequence), orders and customers by key,
``lineitem`` and ``conversations`` by partition and number. A user's events in time order are the revisions of one
document, an error being a deletion.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.revid import rev_hash
from quillgrid.operators import attachments as A
from quillgrid.operators import reduce as RD
from quillgrid.operators import revisions as R
from quillgrid.operators import scan
from quillgrid.operators.changes import ChangesQuery, changes, latest
from quillgrid.operators.find import Find, find
from quillgrid.operators.views import Emit, Index, View, ViewQuery, build, linked_docs, rows
from quillgrid.plans.compile import Row, compile_selector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their id, sequence and parsed props."""
    e = read(spark, sf, "events")
    return e.select(F.lpad(F.col("event_id").cast("string"), 10, "0").alias("_id"), (F.col("event_id") + 1).alias("seq"), "event_id", "user_id", "event_type", "value", F.from_json("props", "struct<k:bigint>").alias("props"))


def found(spark: SparkSession, sf: str, selector: dict) -> DataFrame:
    docs = event_docs(spark, sf)
    return docs.where(compile_selector(selector, Row(docs))).select("_id", "event_type", "value", F.col("props.k").alias("k"))


EVENTS = "(SELECT lpad(event_id::VARCHAR, 10, '0') AS _id, event_id + 1 AS seq, event_id, user_id, event_type, value, json_extract(props, '$.k')::BIGINT AS k FROM events)"
FOUND = f"SELECT _id, event_type, value, k FROM {EVENTS} WHERE "


@query(FOUND + "event_type = 'purchase' AND k >= 20 AND k < 60")
def find_eq_range(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, {"event_type": "purchase", "props": {"k": {"$gte": 20, "$lt": 60}}})


@query(FOUND + "(event_type = 'click' OR coalesce(k > 90, false)) AND NOT (coalesce(value < 10, false) OR event_type = 'error')")
def find_or_nor(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, {"$or": [{"event_type": "click"}, {"props.k": {"$gt": 90}}], "$nor": [{"value": {"$lt": 10}}, {"event_type": "error"}]})


@query(FOUND + "event_type IN ('signup', 'view') AND k NOT IN (1, 2, 3)")
def find_in(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, {"event_type": {"$in": ["signup", "view"]}, "props.k": {"$nin": [1, 2, 3]}})


@query(FOUND + "k % 7 = 3")
def find_mod(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, {"props.k": {"$mod": [7, 3]}})


@query(FOUND + "regexp_matches(event_type, '^(c|s).*[kp]$')")
def find_regex(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, {"event_type": {"$regex": "^(c|s).*[kp]$"}})


@query("SELECT d.doc_id, d.lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL AND d.lang = 'en'")
def find_exists(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source").join(read(spark, sf, "labels"), "doc_id", "left")
    return docs.where(compile_selector({"quality": {"$exists": False}, "lang": "en"}, Row(docs))).select("doc_id", "lang", "source")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality <> 1")
def find_not_missing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return docs.where(compile_selector({"$not": {"quality": 1}}, Row(docs))).select("doc_id", "quality")


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality <> 1")
def find_ne_drops_missing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return docs.where(compile_selector({"quality": {"$ne": 1}}, Row(docs))).select("doc_id", "quality")


@query(FOUND + "value IS NOT NULL AND event_type > 'click' AND event_type <= 'purchase'")
def find_cross_type(spark: SparkSession, sf: str) -> DataFrame:
    """A number is below every string, so the first condition keeps all values that are there."""
    return found(spark, sf, {"value": {"$lt": "a"}, "event_type": {"$gt": "click", "$lte": "purchase"}, "props.k": {"$type": "number"}})


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_returnflag")).alias("flags"))


FLAGS = "(SELECT l_orderkey, list_sort(list(l_returnflag)) AS flags FROM lineitem GROUP BY l_orderkey)"


@query(f"SELECT l_orderkey, len(flags) AS n FROM {FLAGS} WHERE len(list_filter(flags, lambda x: x = 'R')) > 0")
def find_elem_match(spark: SparkSession, sf: str) -> DataFrame:
    docs = flags(spark, sf)
    return docs.where(compile_selector({"flags": {"$elemMatch": {"$eq": "R"}}}, Row(docs))).select("l_orderkey", F.size("flags").cast("bigint").alias("n"))


@query(f"SELECT l_orderkey, len(flags) AS n FROM {FLAGS} WHERE len(list_filter(flags, lambda x: x NOT IN ('A', 'N'))) = 0")
def find_all_match(spark: SparkSession, sf: str) -> DataFrame:
    docs = flags(spark, sf)
    return docs.where(compile_selector({"flags": {"$allMatch": {"$in": ["A", "N"]}}}, Row(docs))).select("l_orderkey", F.size("flags").cast("bigint").alias("n"))


@query(f"SELECT l_orderkey, len(flags) AS n FROM {FLAGS} WHERE list_has_all(flags, ['A', 'N']) AND len(flags) = 4")
def find_all(spark: SparkSession, sf: str) -> DataFrame:
    docs = flags(spark, sf)
    return docs.where(compile_selector({"flags": {"$all": ["A", "N"], "$size": 4}}, Row(docs))).select("l_orderkey", F.size("flags").cast("bigint").alias("n"))


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64 AND label = 2")
def find_size(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "embeddings")
    return docs.where(compile_selector({"embedding": {"$size": 64}, "label": 2}, Row(docs))).select("vec_id", "label")


@query(f"SELECT _id, event_type, k FROM (SELECT *, row_number() OVER (ORDER BY value DESC, _id DESC) AS r FROM {EVENTS} WHERE event_type = 'view' AND value IS NOT NULL) WHERE r > 5 AND r <= 45")
def find_project_sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    request = Find({"event_type": "view"}, sort=[{"value": "desc"}], skip=5, limit=40, fields=["_id", "event_type", "props.k"])
    return find(event_docs(spark, sf), request).docs.select("_id", "event_type", F.col("props.k").alias("k"))


@query(f"SELECT _id, value FROM (SELECT *, row_number() OVER (ORDER BY value, _id) AS r FROM {EVENTS} WHERE user_id < 50 AND value IS NOT NULL AND (value > 50 OR (value = 50 AND _id > '0000000100'))) WHERE r <= 30")
def find_bookmark_page(spark: SparkSession, sf: str) -> DataFrame:
    from quillgrid.operators.find import encode_bookmark

    request = Find({"user_id": {"$lt": 50}}, sort=["value"], limit=30, bookmark=encode_bookmark([50.0, "0000000100"]), fields=["_id", "value"])
    return find(event_docs(spark, sf), request).docs


@query("SELECT event_id, event_type FROM events WHERE json_extract(props, '$.k')::BIGINT > 50 AND event_type <> 'error'")
def find_variant(spark: SparkSession, sf: str) -> DataFrame:
    """The same language over JSON text, in variant mode."""
    e = read(spark, sf, "events")
    docs = e.select("event_id", "event_type", F.to_json(F.struct(F.col("event_id").alias("id"), "event_type", F.from_json("props", "struct<k:bigint>").alias("props"))).alias("body"))
    request = Find({"props": {"k": {"$gt": 50}}, "event_type": {"$ne": "error"}}, limit=2**31 - 1)
    return find(docs, request, doc_id="event_id", body="body").docs.select("event_id", "event_type")


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey")
    return scan.typed_winners(o, F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.col("o_orderkey")).drop("o_orderkey")


ORDER_IDS = "(SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS id FROM orders)"
REV = "'1-00000000000000000000000000000000' AS rev"


@query(f"SELECT id, id AS key, {REV} FROM {ORDER_IDS} WHERE id >= '000000500' AND id < '000002000'")
def all_docs_range(spark: SparkSession, sf: str) -> DataFrame:
    return scan.all_docs(order_docs(spark, sf), "000000500", "000002000", inclusive_end=False).rows


@query(f"SELECT id, id AS key, {REV} FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS r FROM {ORDER_IDS} WHERE id <= '000009000') WHERE r > 10 AND r <= 60")
def all_docs_desc_skip(spark: SparkSession, sf: str) -> DataFrame:
    return scan.all_docs(order_docs(spark, sf), "000009000", descending=True, skip=10, limit=50).rows


@query(f"SELECT v.pos, v.key, o.id, CASE WHEN o.id IS NOT NULL THEN '1-00000000000000000000000000000000' END AS rev, NULL::BOOLEAN AS deleted, CASE WHEN o.id IS NULL THEN 'not_found' END AS error FROM (VALUES (0, '000000007'), (1, 'nope'), (2, '000000001'), (3, '000000007')) v(pos, key) LEFT JOIN {ORDER_IDS} o ON o.id = v.key")
def all_docs_keys(spark: SparkSession, sf: str) -> DataFrame:
    return scan.all_docs_keys(order_docs(spark, sf), ["000000007", "nope", "000000001", "000000007"]).rows


@query(f"SELECT count(*) AS total_rows, count(*) FILTER (id < '000000500') + 3 AS offset FROM {ORDER_IDS}")
def all_docs_offset(spark: SparkSession, sf: str) -> DataFrame:
    page = scan.all_docs(order_docs(spark, sf), "000000500", skip=3)
    return page.total.crossJoin(F.broadcast(page.before))  # one row each


def conversation_docs(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    doc_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    return scan.typed_winners(c.select("conv_id", "turn", "role", F.octet_length("text").alias("size")), doc_id, F.col("turn"), F.col("role") == "system")


@query(f"SELECT id, id AS key, {REV} FROM (SELECT conv_id || ':' || lpad(turn::VARCHAR, 4, '0') AS id, role FROM conversations) WHERE id >= '12:' AND id < '12;' AND role <> 'system'")
def partition_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.partition_docs(conversation_docs(spark, sf), "12").rows


@query("SELECT conv_id::VARCHAR AS partition, count(*) FILTER (role <> 'system') AS doc_count, count(*) FILTER (role = 'system') AS doc_del_count, coalesce(sum(strlen(text)) FILTER (role <> 'system'), 0)::BIGINT AS external_size FROM conversations GROUP BY conv_id")
def partition_stats(spark: SparkSession, sf: str) -> DataFrame:
    return scan.partition_info(conversation_docs(spark, sf), F.col("size"))


def order_index(spark: SparkSession, sf: str, reduce: object = None) -> Index:
    """Key [status, priority, year], value total price."""
    o = read(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("id"), "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
    key = [F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("year")]
    return build(o, View([Emit(key, F.col("o_totalprice"))], reduce=reduce))


def price_index(spark: SparkSession, sf: str, reduce: object = None) -> Index:
    """Key the quantity, value the price, of line items."""
    item = read(spark, sf, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return build(item, View([Emit(F.col("l_quantity"), F.col("l_extendedprice"))], reduce=reduce))


ITEMS = "(SELECT l_orderkey || ':' || l_linenumber AS id, l_quantity AS k0, l_extendedprice AS value, l_returnflag, l_discount FROM lineitem)"
ORDERS = "(SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS id, o_orderstatus AS k0, o_orderpriority AS k1, year(o_orderdate)::INTEGER AS k2, o_totalprice AS value FROM orders)"


@query(f"SELECT id, k0, value FROM {ITEMS} WHERE k0 >= 10 AND k0 < 13")
def view_range(spark: SparkSession, sf: str) -> DataFrame:
    return rows(price_index(spark, sf), ViewQuery(startkey=10, endkey=13, inclusive_end=False)).rows.select("id", "k0", "value")


@query(f"SELECT id, k0, value FROM (SELECT *, row_number() OVER (ORDER BY k0 DESC, id DESC) AS r FROM {ITEMS} WHERE k0 <= 20) WHERE r > 7 AND r <= 107")
def view_desc_skip(spark: SparkSession, sf: str) -> DataFrame:
    return rows(price_index(spark, sf), ViewQuery(startkey=20, descending=True, skip=7, limit=100)).rows.select("id", "k0", "value")


@query(f"SELECT v.pos, i.id, i.k0, i.value FROM (VALUES (0, 49), (1, 3), (2, 49)) v(pos, key) JOIN {ITEMS} i ON i.k0 = v.key")
def view_keys(spark: SparkSession, sf: str) -> DataFrame:
    return rows(price_index(spark, sf), ViewQuery(keys=[49, 3, 49])).rows.select("pos", "id", "k0", "value")


@query(f"SELECT count(*) AS total_rows, count(*) FILTER (k0 < 10) + least(4, count(*) FILTER (k0 >= 10 AND k0 <= 12)) AS offset FROM {ITEMS}")
def view_offset(spark: SparkSession, sf: str) -> DataFrame:
    page = rows(price_index(spark, sf), ViewQuery(startkey=10, endkey=12, skip=4))
    return page.total.crossJoin(F.broadcast(page.before))  # one row each


@query(f"SELECT id, k0 FROM {ITEMS} WHERE (k0 > 10 OR (k0 = 10 AND id >= '3')) AND (k0 < 11 OR (k0 = 11 AND id <= '2'))")
def view_docid_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return rows(price_index(spark, sf), ViewQuery(startkey=10, startkey_docid="3", endkey=11, endkey_docid="2")).rows.select("id", "k0")


@query(f"SELECT id, k0, k1, k2, value FROM {ORDERS} WHERE k0 = 'O' AND (k1 > '2-high' OR (k1 = '2-HIGH' AND k2 >= 1995)) AND k1 < '5'")
def view_compound_range(spark: SparkSession, sf: str) -> DataFrame:
    q = ViewQuery(startkey=["O", "2-HIGH", 1995], endkey=["O", "5"])
    return rows(order_index(spark, sf), q).rows.select("id", "k0", "k1", "k2", "value")


@query("SELECT o.o_orderkey::VARCHAR AS id, o.o_custkey::VARCHAR AS doc_id, c.c_name AS doc FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def view_linked_docs(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_custkey")
    index = build(o, View([Emit(F.col("id"), F.struct(F.col("o_custkey").cast("string").alias("_id")))]))
    customers = scan.typed_winners(read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("doc")), F.col("c_custkey"))
    return linked_docs(index.rows, customers).select("id", "doc_id", "doc")


@query(f"SELECT count(*) AS value FROM {ITEMS} WHERE k0 >= 10 AND k0 <= 20")
def reduce_count(spark: SparkSession, sf: str) -> DataFrame:
    return RD.reduce_rows(price_index(spark, sf, "_count"), ViewQuery(startkey=10, endkey=20))


@query(f"SELECT k0, round(sum(value), 2) AS value FROM {ITEMS} GROUP BY k0")
def reduce_sum(spark: SparkSession, sf: str) -> DataFrame:
    return RD.reduce_rows(price_index(spark, sf, "_sum"), ViewQuery(group=True)).withColumn("value", F.round("value", 2))


@query(f"SELECT k0, round(sum(value), 2) AS sum, count(*) AS count, min(value) AS min, max(value) AS max, round(sum(value * value) / 1e6, 3) AS sumsqr FROM {ITEMS} GROUP BY k0")
def reduce_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = RD.reduce_rows(price_index(spark, sf, "_stats"), ViewQuery(group=True)).select("k0", "value.*")
    return out.withColumn("sum", F.round("sum", 2)).withColumn("sumsqr", F.round(F.col("sumsqr") / 1e6, 3))


def _level(n: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return RD.reduce_rows(order_index(spark, sf, "_sum"), ViewQuery(group_level=n)).withColumn("value", F.round("value", 2))

    run.__name__ = f"reduce_group_level_{n}"
    return run


for _n in (1, 2, 3):
    _keys = ", ".join(f"k{i}" for i in range(_n))
    query(f"SELECT {_keys}, round(sum(value), 2) AS value FROM {ORDERS} GROUP BY {_keys}")(_level(_n))


@query(f"SELECT '[]' AS k, count(*) AS value FROM {ORDERS}")
def reduce_group_level_0(spark: SparkSession, sf: str) -> DataFrame:
    return RD.reduce_rows(order_index(spark, sf, "_count"), ViewQuery(group_level=0))


@query(f"SELECT k0, k1, value FROM (SELECT k0, k1, count(*) AS value, row_number() OVER (ORDER BY k0 DESC, k1 DESC) AS r FROM {ORDERS} GROUP BY k0, k1) WHERE r > 2 AND r <= 8")
def reduce_desc_page(spark: SparkSession, sf: str) -> DataFrame:
    return RD.reduce_rows(order_index(spark, sf, "_count"), ViewQuery(group_level=2, descending=True, skip=2, limit=6))


@query(f"SELECT count(DISTINCT (k0, k1, k2)) AS value FROM {ORDERS}")
def reduce_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return RD.reduce_rows(order_index(spark, sf, "_approx_count_distinct"), ViewQuery())


@query(f"SELECT k0, k1, k2, arg_min(value, id) AS first, arg_max(value, id) AS last FROM {ORDERS} GROUP BY ALL")
def reduce_first_last(spark: SparkSession, sf: str) -> DataFrame:
    first = RD.reduce_rows(order_index(spark, sf, "_first"), ViewQuery(group=True)).withColumnRenamed("value", "first")
    last = RD.reduce_rows(order_index(spark, sf, "_last"), ViewQuery(group=True)).withColumnRenamed("value", "last")
    return first.join(last, ["k0", "k1", "k2"])


@query(f"SELECT k0, value FROM (SELECT k0, value, dense_rank() OVER (PARTITION BY k0 ORDER BY value DESC) AS r FROM (SELECT DISTINCT k0, value FROM {ITEMS})) WHERE r <= 3")
def reduce_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return RD.reduce_rows(price_index(spark, sf, "_top_3"), ViewQuery(group=True)).select("k0", F.explode("value").alias("value"))


@query(f"SELECT k0, value FROM (SELECT k0, value, dense_rank() OVER (PARTITION BY k0 ORDER BY value) AS r FROM (SELECT DISTINCT k0, value FROM {ITEMS})) WHERE r <= 2")
def reduce_bottom_n(spark: SparkSession, sf: str) -> DataFrame:
    return RD.reduce_rows(price_index(spark, sf, "_bottom_2"), ViewQuery(group=True)).select("k0", F.explode("value").alias("value"))


@query(f"SELECT v.pos, count(*) AS value, v.key AS k0 FROM (VALUES (0, 49.0), (1, 3.0), (2, 49.0)) v(pos, key) JOIN {ITEMS} i ON i.k0 = v.key GROUP BY v.pos, v.key")
def reduce_keys(spark: SparkSession, sf: str) -> DataFrame:
    index = price_index(spark, sf, "_count")
    q = ViewQuery(keys=[49, 3, 49], group=True)
    out = RD.reduce_rows(index, q)
    return out.withColumn("pos", F.monotonically_increasing_id() * 0 + F.row_number().over(_by_nothing()) - 1).select(F.col("pos").cast("int").alias("pos"), "value", "k0")


def _by_nothing():  # noqa: ANN202
    from pyspark.sql.window import Window

    return Window.orderBy(F.monotonically_increasing_id())  # three rows


@query("SELECT l_returnflag AS k0, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag")
def reduce_sum_vector(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), "l_returnflag", "l_quantity", "l_extendedprice")
    index = build(item, View([Emit(F.col("l_returnflag"), F.array("l_quantity", "l_extendedprice"))], reduce="_sum"))
    return RD.reduce_rows(index, ViewQuery(group=True)).select("k0", F.round(F.col("value")[0], 2).alias("quantity"), F.round(F.col("value")[1], 2).alias("price"))


@query(f"SELECT (3 - (grouping(k0) + grouping(k1) + grouping(k2)))::INTEGER AS level, k0, k1, k2, count(*) AS count, round(sum(value), 2) AS sum FROM {ORDERS} GROUP BY ROLLUP (k0, k1, k2)")
def reduce_all_levels(spark: SparkSession, sf: str) -> DataFrame:
    return RD.levels(order_index(spark, sf), 3).withColumn("sum", F.round("sum", 2))


def event_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Events as documents of which none has changed twice."""
    e = event_docs(spark, sf)
    return scan.typed_winners(e.drop("seq"), F.col("_id"), F.col("event_id") + 1, F.col("event_type") == "error")


CHANGE = f"SELECT seq, _id AS id, event_type = 'error' AS deleted, ['1-00000000000000000000000000000000'] AS changes FROM {EVENTS} WHERE "


@query(CHANGE + "seq > 700")
def changes_since(spark: SparkSession, sf: str) -> DataFrame:
    return changes(event_winners(spark, sf), ChangesQuery(since="700-opaque")).rows


@query(f"SELECT seq, id, deleted, changes FROM ({CHANGE} seq > 700) ORDER BY seq DESC LIMIT 100")
def changes_desc_limit(spark: SparkSession, sf: str) -> DataFrame:
    return changes(event_winners(spark, sf), ChangesQuery(since=700, descending=True, limit=100)).rows


@query(CHANGE + "_id IN ('0000000003', '0000000500', 'x')")
def changes_doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    return changes(event_winners(spark, sf), ChangesQuery(filter="_doc_ids", doc_ids=["0000000003", "0000000500", "x"])).rows


@query(CHANGE + "event_type = 'purchase' AND k > 40")
def changes_selector(spark: SparkSession, sf: str) -> DataFrame:
    return changes(event_winners(spark, sf), ChangesQuery(filter="_selector", selector={"event_type": "purchase", "props.k": {"$gt": 40}})).rows


@query(CHANGE + "value > 80")
def changes_view(spark: SparkSession, sf: str) -> DataFrame:
    view = View([Emit(F.col("user_id"), when=F.col("value") > 80)])
    return changes(event_winners(spark, sf), ChangesQuery(filter="_view", view=view)).rows


@query("WITH p AS (SELECT event_id + 1 AS seq FROM events WHERE event_type = 'signup' AND event_id + 1 > 100 ORDER BY 1 LIMIT 20) SELECT max(seq) AS last_seq, (SELECT count(*) FROM events WHERE event_id + 1 > (SELECT max(seq) FROM p)) AS pending FROM p")
def changes_pending(spark: SparkSession, sf: str) -> DataFrame:
    winners = event_winners(spark, sf)
    out = changes(winners, ChangesQuery(since=100, limit=20, filter="_selector", selector={"event_type": "signup"}))
    top = out.rows.agg(F.max("seq").alias("last_seq"))
    return winners.crossJoin(F.broadcast(top)).groupBy("last_seq").agg(F.count_if(F.col("seq") > F.col("last_seq")).alias("pending"))  # one row


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def changes_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def event_revs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as revisions: two of three continue the one before, the third forks from the one before that."""
    from pyspark.sql.window import Window

    e = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = e.withColumn("r", F.row_number().over(w))
    fork = (F.col("r") % 3 == 0) & (F.col("r") > 2)
    hash_ = lambda c: F.md5(c.cast("string"))
    parent = F.when(fork, F.lag("event_id", 2).over(w)).otherwise(F.lag("event_id").over(w))
    rows_ = n.withColumn("p", parent).withColumn("pr", F.when(fork, F.col("r") - 2).otherwise(F.col("r") - 1))
    return rows_.select(F.col("user_id").cast("string").alias("id"), F.col("r").alias("num"), hash_(F.col("event_id")).alias("hash"), F.when(F.col("p").isNotNull(), F.col("pr")).cast("int").alias("parent_num"), hash_(F.col("p")).alias("parent_hash"), (F.col("event_type") == "error").alias("deleted"), F.lit("{}").alias("body"), (F.col("event_id") + 1).alias("seq"))


EVENT_REVS = """WITH n AS (
  SELECT user_id, event_id, event_type, row_number() OVER w AS r, lag(event_id) OVER w AS l1, lag(event_id, 2) OVER w AS l2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, CASE WHEN r % 3 = 0 AND r > 2 THEN l2 ELSE l1 END AS p, CASE WHEN r % 3 = 0 AND r > 2 THEN r - 2 ELSE r - 1 END AS pr FROM n),
revs AS (SELECT user_id::VARCHAR AS id, r::INTEGER AS num, md5(event_id::VARCHAR) AS hash, CASE WHEN p IS NOT NULL THEN pr END AS parent_num,
  md5(p::VARCHAR) AS parent_hash, event_type = 'error' AS deleted, event_id + 1 AS seq FROM p),
leaves AS (SELECT * FROM revs r WHERE NOT EXISTS (SELECT 1 FROM revs c WHERE c.id = r.id AND c.parent_num = r.num AND c.parent_hash = r.hash)),
won AS (SELECT * FROM leaves QUALIFY row_number() OVER (PARTITION BY id ORDER BY deleted, num DESC, hash DESC) = 1)
"""


@query(EVENT_REVS + "SELECT w.id, w.num, w.hash, w.deleted, (SELECT max(seq) FROM revs r WHERE r.id = w.id) AS seq, (SELECT count(*) FROM leaves l WHERE l.id = w.id) AS leaves FROM won w")
def winner_pick(spark: SparkSession, sf: str) -> DataFrame:
    return R.winners(event_revs(spark, sf))


@query(EVENT_REVS + "SELECT l.id, list(l.num || '-' || l.hash ORDER BY l.num DESC, l.hash DESC) AS conflicts FROM leaves l JOIN won w ON w.id = l.id AND (w.num, w.hash) <> (l.num, l.hash) WHERE NOT l.deleted GROUP BY l.id")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return R.conflicts(event_revs(spark, sf))


@query(EVENT_REVS + "SELECT id, num, hash, deleted FROM leaves")
def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return R.leaves(event_revs(spark, sf)).select("id", "num", "hash", "deleted")


@query(EVENT_REVS + "SELECT id, list(num || '-' || hash ORDER BY deleted, num DESC, hash DESC) AS revs FROM leaves GROUP BY id")
def changes_all_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return R.all_leaves(event_revs(spark, sf))


@query(EVENT_REVS + """, wanted AS (SELECT id, num + (seq % 2)::INTEGER AS num, hash FROM revs),
lacking AS (SELECT DISTINCT * FROM wanted EXCEPT SELECT id, num, hash FROM revs),
m AS (SELECT id, list(num || '-' || hash ORDER BY num || '-' || hash) AS missing, max(num) AS top FROM lacking GROUP BY id)
SELECT m.id, m.missing, (SELECT list(l.num || '-' || l.hash ORDER BY l.num || '-' || l.hash) FROM leaves l WHERE l.id = m.id AND l.num < m.top) AS possible_ancestors FROM m""")
def revs_diff(spark: SparkSession, sf: str) -> DataFrame:
    revs = event_revs(spark, sf)
    wanted = revs.select("id", (F.col("num") + (F.col("seq") % 2).cast("int")).alias("num"), "hash")
    return R.revs_diff(revs, wanted)


@query("WITH RECURSIVE " + EVENT_REVS.removeprefix("WITH ") + """, chain AS (
  SELECT id, num AS leaf_num, hash AS leaf_hash, 0 AS depth, num, hash, parent_num, parent_hash FROM won
  UNION ALL
  SELECT c.id, c.leaf_num, c.leaf_hash, c.depth + 1, r.num, r.hash, r.parent_num, r.parent_hash
  FROM chain c JOIN revs r ON r.id = c.id AND r.num = c.parent_num AND r.hash = c.parent_hash)
SELECT id, leaf_num, leaf_hash, depth, num, hash FROM chain""")
def ancestry(spark: SparkSession, sf: str) -> DataFrame:
    revs = event_revs(spark, sf)
    return R.ancestry(revs, R.winners(revs))


@query(EVENT_REVS + """,
top AS (SELECT id, num FROM won),
inner_revs AS (SELECT r.* FROM revs r WHERE EXISTS (SELECT 1 FROM revs c WHERE c.id = r.id AND c.parent_num = r.num AND c.parent_hash = r.hash))
SELECT id, num, hash FROM revs EXCEPT SELECT i.id, i.num, i.hash FROM inner_revs i JOIN top t USING (id) WHERE i.num <= t.num - 8""")
def prune_history(spark: SparkSession, sf: str) -> DataFrame:
    return R.prune_history(event_revs(spark, sf), 8).select("id", "num", "hash")


@query("WITH RECURSIVE " + EVENT_REVS.removeprefix("WITH ") + """, near AS (
  SELECT id, num, hash, parent_num, parent_hash, 1 AS depth FROM leaves
  UNION ALL
  SELECT r.id, r.num, r.hash, r.parent_num, r.parent_hash, n.depth + 1 FROM near n JOIN revs r ON r.id = n.id AND r.num = n.parent_num AND r.hash = n.parent_hash WHERE n.depth < 2)
SELECT DISTINCT n.id, n.num, n.hash, l.hash IS NOT NULL AS has_body FROM near n LEFT JOIN leaves l ON l.id = n.id AND l.num = n.num AND l.hash = n.hash""")
def compact_and_stem(spark: SparkSession, sf: str) -> DataFrame:
    return R.stem(event_revs(spark, sf), 2).select("id", "num", "hash", F.col("body").isNotNull().alias("has_body"))


@query(EVENT_REVS + """, asked AS (SELECT seq AS pos, id, CASE WHEN seq % 3 = 0 THEN NULL ELSE num END AS num, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN hash ELSE 'none' END AS hash FROM revs),
pinned AS (SELECT a.pos, a.id, coalesce(a.num, w.num) AS num, CASE WHEN a.num IS NULL THEN w.hash ELSE a.hash END AS hash FROM asked a LEFT JOIN won w USING (id))
SELECT p.pos::BIGINT AS pos, p.id, CASE WHEN r.id IS NOT NULL THEN p.num || '-' || p.hash END AS rev, r.deleted, CASE WHEN r.id IS NULL THEN 'missing' END AS reason
FROM pinned p LEFT JOIN revs r ON r.id = p.id AND r.num = p.num AND r.hash = p.hash""")
def bulk_get(spark: SparkSession, sf: str) -> DataFrame:
    revs = event_revs(spark, sf)
    third = F.col("seq") % 3
    asked = revs.select(F.col("seq").alias("pos"), "id", F.when(third != 0, F.col("num")).alias("num"), F.when(third == 1, F.col("hash")).when(third == 2, F.lit("none")).alias("hash"))
    return scan.bulk_get(R.winners(revs), revs, asked).select("pos", "id", "rev", "deleted", F.col("error.reason").alias("reason"))


@query(EVENT_REVS + "SELECT w.id, w.id AS key, w.num || '-' || w.hash AS rev, '{}' AS doc, (SELECT list(l.num || '-' || l.hash ORDER BY l.num DESC, l.hash DESC) FROM leaves l WHERE l.id = w.id AND NOT l.deleted AND (l.num, l.hash) <> (w.num, w.hash)) AS conflicts FROM won w WHERE NOT w.deleted AND w.id >= '1' AND w.id <= '5'")
def all_docs_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    revs = event_revs(spark, sf)
    return scan.all_docs(R.winners(revs), "1", "5", include_docs=True, conflicts=True, revs=revs).rows


@query("SELECT event_type AS db, count(*) FILTER (user_id % 5 <> 0) AS doc_count, count(*) FILTER (user_id % 5 = 0) AS doc_del_count, max(event_id + 1) AS update_seq, coalesce(sum(strlen(props)) FILTER (user_id % 5 <> 0), 0)::BIGINT AS external_size FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def dbs_info(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(F.col("event_type").alias("db"), (F.col("event_id") + 1).alias("seq"), (F.col("user_id") % 5 == 0).alias("deleted"), "props")
    return scan.dbs_info(e, ["click", "view"], size=F.octet_length("props"))


@query("SELECT DISTINCT lower(p_brand) AS name FROM part WHERE lower(p_brand) >= 'brand#2' AND lower(p_brand) <= 'brand#4'")
def all_dbs(spark: SparkSession, sf: str) -> DataFrame:
    return scan.all_dbs(read(spark, sf, "part").select(F.lower("p_brand").alias("name")).distinct(), "brand#2", "brand#4")


@query("SELECT s_name AS id, '0-' || s_nationkey AS rev, s_acctbal::VARCHAR IS NOT NULL AS has_body FROM supplier WHERE s_name IN ('Supplier#000000003', 'Supplier#000000042', 'none')")
def local_docs(spark: SparkSession, sf: str) -> DataFrame:
    local = read(spark, sf, "supplier").select(F.col("s_name").alias("id"), F.col("s_nationkey").cast("bigint").alias("n"), F.to_json(F.struct("s_acctbal")).alias("body"))
    return scan.local_docs(local, ["Supplier#000000003", "Supplier#000000042", "none"], include_docs=True).select("id", "rev", F.col("body").isNotNull().alias("has_body"))


@query("SELECT coalesce(c.c_name, s.s_name) AS id, coalesce(c.c_nationkey, 0)::BIGINT + CASE WHEN s.s_name IS NOT NULL THEN 1 ELSE 0 END AS n FROM (SELECT replace(c_name, 'Customer', 'x') AS c_name, c_nationkey FROM customer) c FULL JOIN (SELECT replace(s_name, 'Supplier', 'x') AS s_name FROM supplier) s ON s.s_name = c.c_name")
def upsert_local(spark: SparkSession, sf: str) -> DataFrame:
    from quillgrid.operators.write import upsert_local as upsert

    stored = read(spark, sf, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("x")).alias("id"), F.col("c_nationkey").cast("bigint").alias("n"), F.lit("{}").alias("body"))
    batch = read(spark, sf, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("x")).alias("id"), F.lit('{"s":1}').alias("body"))
    return upsert(stored, batch).select("id", "n")


@query("SELECT '_design/' || p_partkey AS id, '_design/' || p_partkey AS key, '1-00000000000000000000000000000000' AS rev FROM part WHERE p_partkey % 10 = 0 AND '_design/' || p_partkey >= '_design/3'")
def design_docs(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select("p_partkey")
    own = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("_design/"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    return scan.design_docs(scan.typed_winners(p, own), startkey="_design/3").rows


@query(f"SELECT id FROM {ORDER_IDS} WHERE id > '000014000'")
def live_scan_after(spark: SparkSession, sf: str) -> DataFrame:
    return scan.live_scan(order_docs(spark, sf), "000014000").select("id")


@query(FOUND + "value IS NOT NULL AND NOT value > 50 AND (k < 10 OR k >= 90)")
def find_field_negation(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf, {"value": {"$not": {"$gt": 50}}, "props.k": {"$or": [{"$lt": 10}, {"$gte": 90}]}})


@query(f"SELECT k0, count(*) AS value FROM {ITEMS} WHERE id LIKE '7:%' GROUP BY k0")
def reduce_partition(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_quantity")
    index = build(item, View([Emit(F.col("l_quantity"))], reduce="_count"), part=F.substring_index("id", ":", 1))
    return RD.reduce_rows(index, ViewQuery(group=True, partition="7"))


@query(f"SELECT id, k0 FROM {ITEMS} WHERE l_returnflag <> 'R' UNION ALL SELECT id, k0 + 1000 FROM {ITEMS} WHERE l_returnflag = 'R'")
def view_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """An index brought up to date: rows of changed documents are replaced."""
    from quillgrid.operators.views import refresh

    item = read(spark, sf, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_quantity", "l_returnflag")
    whole = item.withColumn("id", F.concat_ws(":", "id", "l_returnflag"))
    changed = whole.where("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") + 1000)
    view = View([Emit(F.col("l_quantity"))])
    rows_ = refresh(build(whole, view).rows, changed, build(changed, view).rows)
    return rows_.select(F.substring_index("id", ":", 2).alias("id"), "k0")


@query(f"SELECT _id, row_number() OVER (ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN CASE WHEN k > 50 THEN 2 ELSE 1 END WHEN 'view' THEN 3 ELSE 4 END, CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END, _id) AS place FROM {EVENTS}")
def mixed_key_order(spark: SparkSession, sf: str) -> DataFrame:
    """Null, booleans, numbers and strings in one key column, in the order of all values."""
    from quillgrid.functions.collation import json_key
    from quillgrid.store_queries import numbered

    docs = event_docs(spark, sf)
    key = F.when(F.col("event_type") == "click", "null").when(F.col("event_type") == "error", F.when(F.col("props.k") > 50, "true").otherwise("false")).when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    keyed = docs.select("_id", json_key(key).alias("key"))
    return numbered(keyed.orderBy("key", "_id").select("_id"), "place").withColumn("place", F.col("place") + 1)


@query("SELECT doc_id::VARCHAR AS id, 'md5-' || base64(unhex(md5(coalesce(text, '')))) AS digest, strlen(coalesce(text, ''))::BIGINT AS length FROM documents")
def attachment_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("num"), F.lit("a").alias("hash"), F.lit("text").alias("name"), F.lit("application/octet-stream").alias("content_type"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    return A.put(d, compress=False).select("id", "digest", "length")


@query("SELECT event_type, count(*) AS value FROM events GROUP BY event_type")
def user_map_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """A Python map and a Python reduce over JSON documents."""
    def by_type(doc: dict, emit: Callable) -> None:
        emit(doc["event_type"], 1)

    def total(keys: list | None, values: list, again: bool) -> int:
        return sum(values)

    e = read(spark, sf, "events")
    docs = e.select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.to_json(F.struct("event_type", "value")).alias("doc"))
    out = RD.reduce_rows(build(docs, View(map=by_type, reduce=total)), ViewQuery(group=True))
    return out.select(F.get_json_object(F.concat(F.lit('{"k":'), "key_json", F.lit("}")), "$.k").alias("event_type"), F.col("value").cast("bigint").alias("value"))


def revision_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The first revision of every event, hashed."""
    @F.pandas_udf("string")
    def hashed(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: rev_hash(False, None, x))

    return read(spark, sf, "events").select("event_id", hashed(F.to_json(F.struct("event_type", "value", "user_id"))).alias("hash"))


QUERIES["revision_hashes"] = revision_hashes

