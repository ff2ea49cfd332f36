"""Registered queries that go through stores: writes, feeds, views, indexes, purges, streams and replicas.

Each store is made once for a session and input, by the calls that a user would make:

* ``events``: every event a document; purchases are then changed, errors deleted, a view built, the signups of even users
  purged, and the views of every fifth user changed. Numbers go on after the purge, and the view follows.
* ``suppliers``: every supplier a document with two branches that conflict, and every tenth without its winning one.
* ``pages``: every page a document with its HTML as an attachment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import QueryError, SelectorError
from quillgrid.functions.collation import rendered
from quillgrid.operators import revisions as R
from quillgrid.operators import scan, write
from quillgrid.operators import views as V
from quillgrid.operators.changes import ChangesQuery
from quillgrid.operators.designdocs import DesignDoc, ViewCatalog, map_input
from quillgrid.operators.find import Find, find
from quillgrid.operators.replicate import Options, replicate
from quillgrid.operators.views import Emit, View, ViewQuery, build
from quillgrid.plans.selector import normalize, parse, ranges
from quillgrid.queries import EVENT_REVS, EVENTS, ITEMS, ORDER_IDS, event_docs, event_revs, order_docs, price_index, query, read
from quillgrid.sources.indextable import IndexTable
from quillgrid.sources.scratch import scratch_path
from quillgrid.sources.store import Store
from quillgrid.streaming import feeds

_MADE: dict[tuple, object] = {}


def made(spark: SparkSession, sf: str, make: Callable):  # noqa: ANN201
    key = (spark.sparkContext.applicationId, sf, make.__name__)
    if key not in _MADE:
        _MADE[key] = make(spark, sf)
    return _MADE[key]


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """df with the place of each row in its order, from 0; counted by partition, without one task for all."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType(), False)])
    return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def _edits(df: DataFrame, body: Column, rev: Column | None = None, deleted: bool = False) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.col("event_id").alias("pos"), F.col("_id").alias("id"), (none if rev is None else rev).alias("rev"), F.lit(deleted).alias("deleted"), body.alias("body"))


def _body(*more: Column, value: Column | None = None) -> Column:
    return F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), (F.col("value") if value is None else value).alias("value"), F.col("props.k").alias("k"), *more))


def by_user(doc: dict, emit: Callable) -> None:
    emit(doc["user"], doc.get("value"))


DDOC = DesignDoc("dd", views={"v": View(map=by_user, reduce="_count")})


def events_store(spark: SparkSession, sf: str) -> tuple[Store, ViewCatalog]:
    path = scratch_path(spark, "store")
    store, docs = Store(spark, f"{path}/db"), event_docs(spark, sf)
    store.bulk(_edits(docs, _body()))
    rev = F.concat_ws("-", F.col("num").cast("string"), "hash")
    now = lambda test: docs.where(test).join(store.winners().select(F.col("id").alias("_id"), rev.alias("rev")), "_id")
    store.bulk(_edits(now("event_type = 'purchase'"), _body(value=F.col("value") * 2), F.col("rev")))
    store.bulk(_edits(now("event_type = 'error'"), F.lit("{}"), F.col("rev"), True))
    catalog = ViewCatalog(store, f"{path}/views")
    catalog.register(DDOC)
    catalog.sync("dd")
    gone = docs.where("event_type = 'signup' and user_id % 2 = 0").select(F.col("_id").alias("id")).join(store.winners(), "id")
    store.purge(gone.select("id", "num", "hash"))
    store.bulk(_edits(now("event_type = 'view' and user_id % 5 = 0"), _body(F.lit(True).alias("late")), F.col("rev")))
    store.indexes.create(["type", "k"], "type-k", "dd")
    return store, catalog


HISTORY = f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS s1, count(*) OVER () AS total,
  event_type = 'purchase' AS p, event_type = 'error' AS e, event_type = 'view' AND user_id % 5 = 0 AS v, event_type = 'signup' AND user_id % 2 = 0 AS gone FROM {EVENTS}),
c AS (SELECT *, total + row_number() OVER (PARTITION BY p ORDER BY event_id) AS sp, total + sum(p::INT) OVER () + row_number() OVER (PARTITION BY e ORDER BY event_id) AS se,
  total + sum(p::INT) OVER () + sum(e::INT) OVER () + row_number() OVER (PARTITION BY v ORDER BY event_id) AS sv,
  total + sum(p::INT) OVER () + sum(e::INT) OVER () + sum(v::INT) OVER () AS top FROM n),
docs AS (SELECT _id AS id, event_id, event_type, user_id, k, v AS late, (CASE WHEN p THEN sp WHEN e THEN se WHEN v THEN sv ELSE s1 END)::BIGINT AS seq,
  CASE WHEN p OR e OR v THEN 2 ELSE 1 END AS num, e AS deleted, CASE WHEN p THEN value * 2 ELSE value END AS value, top::BIGINT AS top, total, gone FROM c),
held AS (SELECT * FROM docs WHERE NOT gone),
live AS (SELECT * FROM held WHERE NOT deleted)
"""


@query(HISTORY + "SELECT row_number() OVER (ORDER BY seq) - 1 AS position, seq, id, deleted, num::VARCHAR AS num, CASE WHEN NOT deleted THEN value END AS value FROM held")
def store_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feed in its order, with leaves and documents joined to it."""
    store, _ = made(spark, sf, events_store)
    rows = numbered(store.changes(ChangesQuery(style="all_docs", include_docs=True)).rows.select("seq", "id", "deleted", "changes", "doc"))
    return rows.select("position", "seq", "id", "deleted", F.substring_index(F.col("changes")[0], "-", 1).alias("num"), F.get_json_object("doc", "$.value").cast("double").alias("value"))


@query(HISTORY + ", t AS (SELECT * FROM held WHERE seq > total ORDER BY seq DESC LIMIT 60) SELECT row_number() OVER (ORDER BY seq DESC) - 1 AS position, seq, id, deleted FROM t")
def store_feed_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The newest changes after the first write, newest first."""
    store, _ = made(spark, sf, events_store)
    total = read(spark, sf, "events").count()
    return numbered(store.changes(ChangesQuery(since=f"{total}-x", limit=60, descending=True)).rows.select("seq", "id", "deleted"))


@query(HISTORY + "SELECT max(top) AS update_seq, (SELECT count(*) FROM docs WHERE gone) AS purge_seq, count(*) FILTER (NOT deleted) AS doc_count, count(*) FILTER (deleted) AS doc_del_count FROM held")
def store_info(spark: SparkSession, sf: str) -> DataFrame:
    store, _ = made(spark, sf, events_store)
    said = store.info()
    names = ("update_seq", "purge_seq", "doc_count", "doc_del_count")
    return spark.createDataFrame([tuple(said[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@query(HISTORY + ", w AS (SELECT seq FROM held WHERE seq > 10 AND event_type = 'view' ORDER BY seq LIMIT 25) SELECT (SELECT max(seq) FROM w) AS last_seq, (SELECT count(*) FROM held WHERE seq > (SELECT max(seq) FROM w)) AS pending, (SELECT max(top) FROM docs) AS now")
def store_feed_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """last_seq and pending of a filtered, limited feed, and what "now" stands for."""
    store, _ = made(spark, sf, events_store)
    found = store.changes(ChangesQuery(since=10, limit=25, filter="_selector", selector={"type": "view"}))
    return spark.createDataFrame([(found.last_seq(), found.pending(), store.changes(ChangesQuery(since="now")).since)], "last_seq bigint, pending bigint, now bigint")


@query(HISTORY + "SELECT seq, id FROM held WHERE NOT deleted AND value > 50")
def store_feed_user_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A Python filter; documents at which it fails are dropped."""
    store, _ = made(spark, sf, events_store)
    return store.changes(ChangesQuery(filter=lambda doc, request: doc["value"] > request["query"]["least"], params={"least": 50})).rows.select("seq", "id")


@query(HISTORY + "SELECT id, count(*)::INTEGER AS purged_revisions FROM docs WHERE gone GROUP BY id")
def store_purges(spark: SparkSession, sf: str) -> DataFrame:
    store, _ = made(spark, sf, events_store)
    return store.purged_since(0).groupBy("id").agg(F.count("*").cast("int").alias("purged_revisions"))


@query(HISTORY + "SELECT id, num, deleted, seq FROM held")
def store_winners(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, events_store)[0].winners().select("id", "num", "deleted", "seq")


@query(HISTORY + "SELECT row_number() OVER (ORDER BY user_id, id) - 1 AS position, id, user_id AS key, value FROM live")
def store_view(spark: SparkSession, sf: str) -> DataFrame:
    """A stored view, built before changes and purges and brought up to date."""
    _, catalog = made(spark, sf, events_store)
    rows = catalog.query("dd", "v", ViewQuery(reduce=False)).rows.select("id", "key_json", "value_json")
    return numbered(rows).select("position", "id", F.col("key_json").cast("bigint").alias("key"), F.when(F.col("value_json") != "null", F.col("value_json")).cast("double").alias("value"))


@query(HISTORY + ", r AS (SELECT * FROM live WHERE user_id >= 10 AND user_id <= 40 ORDER BY user_id DESC, id DESC OFFSET 5 LIMIT 80) SELECT row_number() OVER (ORDER BY user_id DESC, id DESC) - 1 AS position, id, event_type AS type, coalesce(late, false) AS late FROM r")
def store_view_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a stored view with its documents, in descending order."""
    _, catalog = made(spark, sf, events_store)
    q = ViewQuery(startkey=40, endkey=10, descending=True, skip=5, limit=80, include_docs=True, reduce=False)
    rows = numbered(catalog.query("dd", "v", q).rows.select("id", "doc"))
    return rows.select("position", "id", F.get_json_object("doc", "$.type").alias("type"), F.coalesce(F.get_json_object("doc", "$.late").cast("boolean"), F.lit(False)).alias("late"))


@query(HISTORY + "SELECT user_id AS key, count(*) AS value FROM live GROUP BY user_id")
def store_view_reduce(spark: SparkSession, sf: str) -> DataFrame:
    _, catalog = made(spark, sf, events_store)
    return catalog.query("dd", "v", ViewQuery(group=True)).select(F.col("key_json").cast("bigint").alias("key"), "value")


@query(HISTORY + "SELECT 0 AS page, id FROM live WHERE user_id = 7 UNION ALL SELECT 1, id FROM live WHERE user_id IN (3, 5) UNION ALL SELECT 2, id FROM (SELECT id FROM live ORDER BY user_id, id LIMIT 4)")
def store_view_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Several queries of a stored view at once: one key, several keys, the first rows."""
    _, catalog = made(spark, sf, events_store)
    asked = [ViewQuery(key=7, reduce=False), ViewQuery(keys=[3, 5], reduce=False), ViewQuery(limit=4, reduce=False)]
    one, *rest = (p.rows.select(F.lit(i).alias("page"), "id") for i, p in enumerate(catalog.queries("dd", "v", asked)))
    for p in rest:
        one = one.unionByName(p)
    return one


@query(HISTORY + "SELECT (SELECT max(top) FROM docs) AS update_seq, (SELECT count(*) FROM docs WHERE gone) AS purge_seq")
def store_view_info(spark: SparkSession, sf: str) -> DataFrame:
    _, catalog = made(spark, sf, events_store)
    catalog.sync("dd")
    said = catalog.info("dd")
    return spark.createDataFrame([(said["update_seq"], said["purge_seq"])], "update_seq bigint, purge_seq bigint")


INDEXED = {"type": "view", "k": {"$gte": 20, "$lt": 40}}


@query(HISTORY + "SELECT row_number() OVER (ORDER BY k, id) - 1 AS position, id AS _id, k FROM live WHERE event_type = 'view' AND k >= 20 AND k < 40")
def store_find_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents by a two-field index, in its order."""
    store, _ = made(spark, sf, events_store)
    found = store.find(Find(INDEXED, sort=["type", "k"], limit=2**31 - 1, strict=True))
    assert found.index is not None and found.index.name == "type-k"
    return numbered(found.docs.select("_id", F.get_json_object("body", "$.k").cast("bigint").alias("k")))


@query(HISTORY + "SELECT id AS _id, event_type AS type FROM live WHERE event_type IN ('purchase', 'signup') AND k % 5 = 2 AND value > 20")
def store_find_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents that no index covers, cut to a field."""
    store, _ = made(spark, sf, events_store)
    found = store.find(Find({"type": {"$in": ["purchase", "signup"]}, "k": {"$mod": [5, 2]}, "value": {"$gt": 20}}, limit=2**31 - 1, fields=["type"]))
    return found.docs.select("_id", F.get_json_object("body", "$.type").alias("type"))


@query(HISTORY + "SELECT h.id, h.num::VARCHAR AS num, h.deleted FROM held h WHERE event_id % 97 = 3")
def store_point_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Winners of listed ids, tombstones included, missing ones absent."""
    store, _ = made(spark, sf, events_store)
    asked = event_docs(spark, sf).where("event_id % 97 = 3").select(F.col("_id").alias("id"))
    return scan.get_many(store.winners(), asked).select("id", F.col("num").cast("string").alias("num"), "deleted")


@query(HISTORY + "SELECT id, num AS start, num AS generations, NOT deleted AND late AS late FROM held WHERE event_id % 11 = 0")
def store_bulk_get(spark: SparkSession, sf: str) -> DataFrame:
    """Winners in bulk with their ancestry."""
    store, _ = made(spark, sf, events_store)
    asked = event_docs(spark, sf).where("event_id % 11 = 0").select(F.col("event_id").alias("pos"), F.col("_id").alias("id"), F.lit(None).cast("int").alias("num"), F.lit(None).cast("string").alias("hash"))
    rows = store.bulk_get(asked, revisions=True).where("error is null")
    late = F.coalesce(F.get_json_object("body", "$.late").cast("boolean"), F.lit(False))
    return rows.select("id", F.col("revisions.start").alias("start"), F.size("revisions.ids").alias("generations"), late.alias("late"))


@query(HISTORY + """, asked AS (SELECT d.*, event_id % 3 AS way FROM docs d),
said AS (SELECT *, CASE WHEN way = 2 THEN 'conflict' WHEN way = 0 AND NOT gone AND NOT deleted THEN 'conflict' WHEN user_id % 4 = 0 THEN 'forbidden' END AS error FROM asked)
SELECT id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN CASE WHEN gone THEN 1 ELSE num + 1 END END AS num FROM said""")
def write_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A bulk write's answers: edits without revision, with the right one and with a wrong one, under a validator."""
    store, _ = made(spark, sf, events_store)
    held = store.winners().select(F.col("id").alias("_id"), F.concat_ws("-", F.col("num").cast("string"), "hash").alias("now"))
    docs = event_docs(spark, sf).join(held, "_id", "left")
    rev = F.when(F.col("event_id") % 3 == 1, F.col("now")).when(F.col("event_id") % 3 == 2, F.lit("9-abc"))
    refuse = lambda new, old: ("forbidden", "fourth") if new["user"] % 4 == 0 else None
    return write.apply_edits(store.revs(), _edits(docs, _body(), rev), refuse).select("id", "ok", "error", "num")


def replica_of_all(spark: SparkSession, sf: str) -> Store:
    target = Store(spark, f"{scratch_path(spark, 'replicas')}/all")
    replicate(made(spark, sf, events_store)[0], target, batch=4000)
    return target


def replica_of_some(spark: SparkSession, sf: str) -> Store:
    target = Store(spark, f"{scratch_path(spark, 'replicas')}/some")
    replicate(made(spark, sf, events_store)[0], target, Options(selector={"type": "view", "late": True}))
    return target


@query(HISTORY + "SELECT id, num, deleted FROM held")
def replica_docs(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, replica_of_all).winners().select("id", "num", "deleted")


@query(HISTORY + "SELECT id, num, deleted FROM held WHERE late")
def replica_selected(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf, replica_of_some).winners().select("id", "num", "deleted")


@query(HISTORY + "SELECT id, seq FROM docs")
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each document in the log, kept by a stream."""
    store, _ = made(spark, sf, events_store)
    at = scratch_path(spark, "stream")
    feeds.run_once(feeds.log_stream(store, 4), feeds.keep_latest(spark, f"{at}/rows"), f"{at}/checkpoint")
    return feeds.read_latest(spark, f"{at}/rows").select("id", "seq")


@query(HISTORY + "SELECT id, user_id AS key FROM live")
def stream_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view kept up to date by a stream over writes, deletions and a purge."""
    store, _ = made(spark, sf, events_store)
    at = scratch_path(spark, "stream")
    feeds.run_once(feeds.log_stream(store, 4), feeds.incremental_view(store, f"{at}/rows", View(map=by_user)), f"{at}/checkpoint")
    return IndexTable(spark, f"{at}/rows").read().select("id", F.col("key_json").cast("bigint").alias("key"))


@query(HISTORY + "SELECT id, seq, deleted FROM held")
def stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as JSON lines by a stream."""
    store, _ = made(spark, sf, events_store)
    at = scratch_path(spark, "stream")
    feeds.run_once(feeds.log_stream(store), feeds.lines_sink(store, f"{at}/lines"), f"{at}/checkpoint")
    return spark.read.schema("id string, seq bigint, deleted boolean").json(f"{at}/lines").select("id", "seq", "deleted").distinct()


def suppliers_store(spark: SparkSession, sf: str) -> tuple[Store, ViewCatalog]:
    path, s = scratch_path(spark, "conflicts"), read(spark, sf, "supplier")
    store = Store(spark, f"{path}/db")
    root = F.struct(F.lit(1).alias("num"), F.md5("s_name").alias("hash"))
    branch = lambda letter: s.select(F.col("s_name").alias("id"), F.array(F.struct(F.lit(2).alias("num"), F.md5(F.concat(F.lit(letter), "s_name")).alias("hash")), root).alias("path"), F.lit(False).alias("deleted"), F.to_json(F.struct(F.lit(letter).alias("branch"), F.col("s_nationkey").alias("nation"))).alias("body"))
    store.force(branch("a").unionByName(branch("b")))
    catalog = ViewCatalog(store, f"{path}/views")
    catalog.register(DesignDoc("dd", views={"v": View(map=by_branch)}))
    catalog.sync("dd")
    won = store.winners().join(s.where("s_suppkey % 10 = 0").select(F.col("s_name").alias("id")), "id", "left_semi")
    store.purge(won.select("id", "num", "hash"))
    return store, catalog


def by_branch(doc: dict, emit: Callable) -> None:
    emit([doc["nation"], doc["branch"]], len(doc.get("_conflicts", [])))


BRANCHES = """WITH b AS (SELECT s_name AS id, s_nationkey AS nation, s_suppkey % 10 = 0 AS cut, md5('a' || s_name) AS ha, md5('b' || s_name) AS hb FROM supplier),
w AS (SELECT *, CASE WHEN (ha > hb) <> cut THEN 'a' ELSE 'b' END AS branch, CASE WHEN (ha > hb) <> cut THEN ha ELSE hb END AS won, CASE WHEN NOT cut THEN '2-' || least(ha, hb) END AS lost FROM b)
"""


@query(BRANCHES + "SELECT id, '2-' || won AS rev, lost AS conflict, branch FROM w")
def conflicts_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Winners and conflicts of forced branches, after purges of some winners."""
    store, _ = made(spark, sf, suppliers_store)
    rows = store.all_docs(include_docs=True, conflicts=True).rows
    return rows.select("id", "rev", F.col("conflicts")[0].alias("conflict"), F.get_json_object("doc", "$.branch").alias("branch"))


@query(BRANCHES + "SELECT row_number() OVER (ORDER BY nation, branch, id) - 1 AS position, id, (lost IS NOT NULL)::INTEGER AS seen, lost AS conflict, branch FROM w")
def conflicts_in_views(spark: SparkSession, sf: str) -> DataFrame:
    """What a map sees of conflicts, and those of included documents."""
    _, catalog = made(spark, sf, suppliers_store)
    rows = numbered(catalog.query("dd", "v", ViewQuery(include_docs=True, conflicts=True)).rows.select("id", "value_json", "conflicts", "doc"))
    return rows.select("position", "id", F.col("value_json").cast("int").alias("seen"), F.col("conflicts")[0].alias("conflict"), F.get_json_object("doc", "$.branch").alias("branch"))


@query(BRANCHES + "SELECT id, '2-' || won AS winner, (lost IS NOT NULL)::INTEGER + 1 AS leaves FROM w")
def conflicts_in_feeds(spark: SparkSession, sf: str) -> DataFrame:
    store, _ = made(spark, sf, suppliers_store)
    return store.changes(ChangesQuery(style="all_docs")).rows.select("id", F.col("changes")[0].alias("winner"), F.size("changes").alias("leaves"))


@query("SELECT '2-' || md5(l || s_name) AS rev, md5(s_name) AS parent, 2 AS start FROM supplier, (VALUES ('a'), ('b')) v(l) WHERE s_suppkey = 7")
def leaves_of_one(spark: SparkSession, sf: str) -> DataFrame:
    """All leaves of one document with their ancestry."""
    store, _ = made(spark, sf, suppliers_store)
    name = read(spark, sf, "supplier").where("s_suppkey = 7").first()["s_name"]
    return R.open_revs(store.revs(), name, with_path=True).select("rev", F.col("revisions.ids")[1].alias("parent"), F.col("revisions.start").alias("start"))


@query(BRANCHES + "SELECT id, branch, coalesce(lost, '') AS conflict FROM w WHERE nation = 3")
def map_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What maps get: the document with its id and conflicts."""
    store, _ = made(spark, sf, suppliers_store)
    docs = map_input(store)
    at = lambda path: F.get_json_object("doc", path)
    return docs.where(at("$.nation") == "3").select(at("$._id").alias("id"), at("$.branch").alias("branch"), F.coalesce(at("$._conflicts[0]"), F.lit("")).alias("conflict"))


def pages_store(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, scratch_path(spark, "pages"))
    file = F.struct(F.struct(F.lit("text/html").alias("content_type"), F.translate(F.base64(F.encode("html", "utf-8")), "\r\n", "").alias("data")).alias("page.html"))
    body = F.to_json(F.struct("url", F.when(F.col("html").isNotNull(), file).alias("_attachments")))
    store.bulk(read(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.col("page_id").cast("string").alias("id"), F.lit(None).cast("string").alias("rev"), F.lit(False).alias("deleted"), body.alias("body")))
    store.compact()
    return store


@query("SELECT page_id::VARCHAR AS id, 'text/html' AS content_type, strlen(html)::BIGINT AS length, md5(html) AS md5, 1 AS revpos FROM pages WHERE html IS NOT NULL")
def attachments_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments written with documents, compressed, compacted, and read back as they came."""
    from quillgrid.operators import attachments as A

    store = made(spark, sf, pages_store)
    rows = A.entries(store.revs()).join(store.blobs(), "digest")
    return rows.select("id", "content_type", "length", F.md5(A.plain()).alias("md5"), "revpos")


@query(EVENT_REVS + ", top AS (SELECT id, max(num) AS n FROM revs GROUP BY id) SELECT id, num, hash, parent_num, deleted FROM revs UNION ALL SELECT t.id, t.n + 1, 'forced', t.n, false FROM top t")
def forced_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """A revision forced onto each document's newest; what is known changes nothing."""
    revs = event_revs(spark, sf)
    top = revs.groupBy("id").agg(F.max(F.struct("num", "hash")).alias("t"))
    path = F.array(F.struct((F.col("t.num") + 1).alias("num"), F.lit("forced").alias("hash")), F.col("t"))
    docs = top.select("id", path.alias("path"), F.lit(False).alias("deleted"), F.lit("{}").alias("body"), F.lit(0).cast("bigint").alias("seq"))
    return R.forced(revs, docs).select("id", "num", "hash", "parent_num", "deleted")


@query("WITH RECURSIVE " + EVENT_REVS.removeprefix("WITH ") + """, up AS (
  SELECT id, num, hash, parent_num, parent_hash, deleted AS asked FROM leaves
  UNION ALL
  SELECT r.id, r.num, r.hash, r.parent_num, r.parent_hash, u.asked FROM up u JOIN revs r ON r.id = u.id AND r.num = u.parent_num AND r.hash = u.parent_hash)
SELECT id, num, hash FROM up GROUP BY id, num, hash HAVING NOT bool_and(asked)""")
def purge_trees(spark: SparkSession, sf: str) -> DataFrame:
    """What is left when all deleted leaves are purged, each with the ancestors that only such leaves have."""
    revs = event_revs(spark, sf)
    gone = R.leaf_keys(revs).where("deleted")
    return R.purge(revs, gone).select("id", "num", "hash")


@query("""WITH g AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, coalesce(strlen(text), 0)::BIGINT AS growth FROM conversations)
SELECT id, growth, growth = 0 OR coalesce(sum(growth) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 300 AS accepted FROM g""")
def partition_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that grow their conversation: the one that crosses the limit passes, later ones don't."""
    c = read(spark, sf, "conversations")
    edits = c.select(F.col("turn").alias("pos"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("growth"))
    return write.limit_partitions(edits, spark.createDataFrame([], "part string, size bigint"), 300).select("id", "growth", "accepted")


@query(f"SELECT c AS bounds, (SELECT count(*) FROM {ORDER_IDS} WHERE (c = 'null up' OR c = 'to array' OR c = 'number down') AND id IS NOT NULL) AS n FROM (VALUES ('null up'), ('to array'), ('number down'), ('from array'), ('to number'), ('object down')) v(c)")
def all_docs_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds that aren't strings lie before or after all ids."""
    docs = order_docs(spark, sf)
    cases = {"null up": {"startkey": None}, "to array": {"endkey": ["x"]}, "number down": {"endkey": 5, "descending": True}, "from array": {"startkey": []}, "to number": {"endkey": 7}, "object down": {"endkey": {}, "descending": True}}
    one, *rest = (scan.all_docs(docs, **q).rows.agg(F.lit(name).alias("bounds"), F.count("*").alias("n")) for name, q in cases.items())
    for more in rest:
        one = one.unionByName(more)
    return one


@query(f"SELECT 0 AS page, id FROM {ORDER_IDS} WHERE id >= '000009000' UNION ALL SELECT 1, id FROM {ORDER_IDS} WHERE id IN ('000000001', '000000003') UNION ALL SELECT 2, id FROM (SELECT id FROM {ORDER_IDS} ORDER BY id DESC LIMIT 3)")
def all_docs_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Several scans at once."""
    pages = scan.batches(order_docs(spark, sf), [{"startkey": "000009000"}, {"keys": ["000000003", "000000001"]}, {"descending": True, "limit": 3}])
    one, *rest = (p.rows.select(F.lit(i).alias("page"), "id") for i, p in enumerate(pages))
    for p in rest:
        one = one.unionByName(p)
    return one


@query("SELECT event_id AS event_seq, event_type AS db FROM events WHERE event_id > 200 AND event_type IN ('signup', 'error')")
def database_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").where("event_type in ('signup', 'error')")
    return scan.db_events(e.select(F.col("event_id").alias("event_seq"), F.col("event_type").alias("db")), 200)


def _json_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = event_docs(spark, sf)
    body = F.to_json(F.struct("event_type", "value", "user_id", "props", F.array("event_type", F.col("user_id").cast("string")).alias("tags"), F.create_map(F.col("event_type"), F.lit(1)).alias("by")))
    return docs.select("_id", body.alias("body"))


JSON_CASES = {
    "eq_range": ({"event_type": "purchase", "props": {"k": {"$gte": 20, "$lt": 60}}}, "event_type = 'purchase' AND k >= 20 AND k < 60"),
    "or_nor": ({"$or": [{"event_type": "click"}, {"props.k": {"$gt": 90}}], "$nor": [{"value": {"$lt": 10}}, {"event_type": "error"}]}, "(event_type = 'click' OR coalesce(k > 90, false)) AND NOT (coalesce(value < 10, false) OR event_type = 'error')"),
    "in_nin": ({"event_type": {"$in": ["signup", "view"]}, "props.k": {"$nin": [1, 2, 3]}}, "event_type IN ('signup', 'view') AND k NOT IN (1, 2, 3)"),
    "in_array": ({"tags": {"$in": ["17", "error"]}}, "event_type = 'error' OR user_id = 17"),
    "mod": ({"props.k": {"$mod": [7, 3]}}, "k % 7 = 3"),
    "regex": ({"event_type": {"$regex": "^(c|s).*[kp]$"}}, "regexp_matches(event_type, '^(c|s).*[kp]$')"),
    "exists": ({"value": {"$exists": False}}, "value IS NULL"),
    "missing": ({"nothing": {"$exists": False}, "value": {"$exists": True}}, "value IS NOT NULL"),
    "ne": ({"event_type": {"$ne": "view"}}, "event_type <> 'view'"),
    "type": ({"value": {"$type": "number"}, "event_type": {"$type": "string"}, "tags": {"$type": "array"}, "props": {"$type": "object"}}, "value IS NOT NULL"),
    "cross_type": ({"value": {"$lt": "a"}, "event_type": {"$gt": 5}}, "value IS NOT NULL"),
    "not": ({"value": {"$not": {"$gt": 50}}, "props.k": {"$or": [{"$lt": 10}, {"$gte": 90}]}}, "value IS NOT NULL AND NOT value > 50 AND (k < 10 OR k >= 90)"),
    "size_all": ({"tags": {"$size": 2, "$all": ["view", "5"]}}, "event_type = 'view' AND user_id = 5"),
    "elem_match": ({"tags": {"$elemMatch": {"$regex": "^pur"}}}, "event_type = 'purchase'"),
    "all_match": ({"tags": {"$allMatch": {"$gt": "5"}}}, "user_id::VARCHAR > '5' AND event_type > '5'"),
    "key_map": ({"by": {"$keyMapMatch": {"$in": ["click", "error"]}}}, "event_type IN ('click', 'error')"),
    "whole_object": ({"props": {"k": 42}}, "k = 42"),
    "empty_object": ({"props": {}}, "false"),
    "array_order": ({"tags": {"$gte": ["view"], "$lt": ["view", "3"]}}, "event_type = 'view' AND user_id::VARCHAR < '3'"),
    "everything": ({}, "true"),
}


def _json_query(name: str, selector: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return find(_json_docs(spark, sf), Find(selector, limit=2**31 - 1), body="body").docs.select("_id")

    run.__name__ = f"json_{name}"
    return run


for _name, (_selector, _test) in JSON_CASES.items():
    query(f"SELECT _id FROM {EVENTS} WHERE {_test}")(_json_query(_name, _selector))


@query(f"""SELECT _id, CASE event_type WHEN 'view' THEN '{{"event_type":"view","props":{{"k":' || k || '}}}}' ELSE '{{"event_type":"' || event_type || '","props":{{"k":' || k || '}}}}' END AS body FROM {EVENTS} WHERE user_id = 3 AND k IS NOT NULL""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Stored bodies cut to listed paths, nesting rebuilt."""
    request = Find({"user_id": 3, "props.k": {"$exists": True}}, limit=2**31 - 1, fields=["event_type", "props.k", "none.such"])
    return find(_json_docs(spark, sf), request, body="body").docs.select("_id", "body")


@query(f"SELECT row_number() OVER (ORDER BY value DESC, _id DESC) - 1 AS position, _id FROM (SELECT * FROM {EVENTS} WHERE user_id < 20 AND value IS NOT NULL ORDER BY value DESC, _id DESC OFFSET 4 LIMIT 50)")
def json_sorted_page(spark: SparkSession, sf: str) -> DataFrame:
    """Sort, skip and limit over stored bodies, in order; documents without the field go."""
    request = Find({"user_id": {"$lt": 20}}, sort=[{"value": "desc"}], skip=4, limit=50)
    return numbered(find(_json_docs(spark, sf), request, body="body").docs.select("_id"))


#: Selectors, their normal form as canonical JSON, and what is wrong with others.
NORMAL = {
    '{"a":1}': '{"a":{"$eq":1}}',
    '{"a":{"b":{"$gt":1,"$lt":3}}}': '{"$and":[{"a.b":{"$gt":1}},{"a.b":{"$lt":3}}]}',
    '{"$nor":[{"x":1}]}': '{"$nor":[{"x":{"$eq":1}}]}',
    '{"$not":{"x":{"$in":[1]}}}': '{"$not":{"x":{"$in":[1]}}}',
    '{"n":{"$odd":1}}': "invalid_operator",
    '{"n":{"$mod":[0,1]}}': "bad_arg",
    '{"n":{"$size":"x"}}': "bad_arg",
    '{"n":{"$gt":1,"m":2}}': "invalid_operator",
    "[1]": "invalid_selector_json",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NORMAL.items()) + ") v(selector, normal)")
def selector_normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    import json

    def said(text: str) -> str:
        try:
            return json.dumps(normalize(json.loads(text)), separators=(",", ":"))
        except SelectorError as bad:
            return bad.error

    return spark.createDataFrame([(x, said(x)) for x in NORMAL], "selector string, normal string")


@query("SELECT * FROM (VALUES ('a', '5', NULL, NULL), ('b', NULL, '3 true', '9 false'), ('c.d', NULL, '\"x\" false', NULL)) v(field, equal, low, high)")
def selector_ranges(spark: SparkSession, sf: str) -> DataFrame:
    import json

    found = ranges(parse({"a": 5, "$and": [{"b": {"$gt": 1}}, {"b": {"$gte": 3, "$lt": 9}}, {"b": {"$lte": 9}}], "c": {"d": {"$gt": "x"}}, "$or": [{"e": 1}]}))
    edge = lambda x: None if x is None else f"{json.dumps(x[0])} {str(x[1]).lower()}"
    rows = [(name, json.dumps(r.eq) if r.has_eq else None, edge(r.low), edge(r.high)) for name, r in found.items()]
    return spark.createDataFrame(rows, "field string, equal string, low string, high string")


BAD_VIEWS = {
    "reduce a map": (ViewQuery(reduce=True), None),
    "group a map": (ViewQuery(group=True), None),
    "documents of a reduction": (ViewQuery(include_docs=True), "_count"),
    "keys and key": (ViewQuery(keys=[1], key=1), None),
    "keys without group": (ViewQuery(keys=[1, 2]), "_count"),
    "no such range": (ViewQuery(startkey=3, endkey=1), None),
    "partition of a global view": (ViewQuery(partition="p"), None),
    "negative skip": (ViewQuery(skip=-1), None),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', 'query_parse_error')" for c in BAD_VIEWS) + ") v(request, error)")
def view_argument_checks(spark: SparkSession, sf: str) -> DataFrame:
    def said(q: ViewQuery, reducer: str | None) -> str:
        try:
            q.check(reducer)
        except QueryError as bad:
            return bad.error
        return "none"

    return spark.createDataFrame([(c, said(*x)) for c, x in BAD_VIEWS.items()], "request string, error string")


@query(f"SELECT 0 AS page, id FROM {ITEMS} WHERE k0 = 11 UNION ALL SELECT 1, id FROM (SELECT id FROM {ITEMS} ORDER BY k0 DESC, id DESC LIMIT 5)")
def view_batch(spark: SparkSession, sf: str) -> DataFrame:
    one, two = (p.rows.select(F.lit(i).alias("page"), "id") for i, p in enumerate(V.batches(price_index(spark, sf), [ViewQuery(key=11), ViewQuery(descending=True, limit=5)])))
    return one.unionByName(two)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = round(l_extendedprice) THEN l_extendedprice::BIGINT::VARCHAR ELSE l_extendedprice::VARCHAR END AS text FROM lineitem")
def rendered_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rendered(F.col("l_extendedprice")).alias("text"))


@query("SELECT event_id, '{\"a\":' || event_id || ',\"b\":{\"x\":1,\"y\":' || user_id || '}}' AS text FROM events")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text with the members of all objects in order."""
    from quillgrid.functions.helpers import canonical

    e = read(spark, sf, "events")
    raw = F.concat(F.lit('{"b": {"y": '), F.col("user_id").cast("string"), F.lit(', "x": 1}, "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", canonical(raw).alias("text"))


@query("SELECT kind, 300::BIGINT AS ids, true AS sorted FROM (VALUES ('random'), ('sequential'), ('utc_random'), ('utc_id')) v(kind)")
def generated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every kind: distinct (but utc_id within a microsecond), and in the order of the rows where it is promised."""
    def of(kind: str) -> DataFrame:
        ids = spark.range(300).repartitionByRange(3, "id").sortWithinPartitions("id").select("id", write.new_id(kind, "-x").alias("doc"))
        n = F.count("*") if kind == "utc_id" else F.count_distinct("doc")
        order = F.array_sort(F.collect_list("doc")) == F.transform(F.array_sort(F.collect_list(F.struct("id", "doc"))), lambda x: x["doc"]) if kind == "sequential" else F.lit(True)
        return ids.agg(F.lit(kind).alias("kind"), n.alias("ids"), order.alias("sorted"))

    one, *rest = map(of, ("random", "sequential", "utc_random", "utc_id"))
    for more in rest:
        one = one.unionByName(more)
    return one


@query(f"SELECT round(sum(value), 2) AS total FROM {ITEMS}")
def user_reduce_whole_range(spark: SparkSession, sf: str) -> DataFrame:
    """A Python reduction of all rows as one group, which every partition folds."""
    from quillgrid.operators import reduce as RD

    def total(keys: list | None, values: list, again: bool) -> float:
        return sum(values)

    item = read(spark, sf, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_quantity", "l_extendedprice")
    out = RD.reduce_rows(build(item, View([Emit(F.col("l_quantity"), F.col("l_extendedprice"))], reduce=total)), ViewQuery())
    return out.select(F.round(F.col("value").cast("double"), 2).alias("total"))
