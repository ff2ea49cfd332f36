"""Scans by primary key: ranges, multi-key lookups, design documents, partitions, point and batched reads.

``winners`` tables have id, num, hash, deleted, seq (see ``revisions.winners``); ids order by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.collation import ARRAY, STRING, rank_of
from quillgrid.operators import revisions as R

UNSET: Any = object()


@dataclass
class Page:
    """Rows, and the scalars that go with them as one-row DataFrames; nothing runs until they are read."""

    rows: DataFrame
    total: DataFrame | None = None
    before: DataFrame | None = None

    def total_rows(self) -> int | None:
        return None if self.total is None else self.total.first()[0]

    def offset(self) -> int | None:
        return None if self.before is None else self.before.first()[0]

    def json(self) -> str:
        """The page as JSON text: a driver-side sink for rows that a limit bounds."""
        import json

        rows = [json.loads(x) for x in self.rows.toJSON().collect()]
        return json.dumps({"total_rows": self.total_rows(), "offset": self.offset(), "rows": rows})


def rev_text() -> Column:
    return F.concat_ws("-", F.col("num").cast("string"), F.col("hash"))


def _bound(key: Any, column: Column, low: bool, inclusive: bool = True) -> Column:
    """id >= key (low) or id <= key: keys that aren't strings lie before or after all ids."""
    rank = rank_of(key)
    if rank != STRING:
        return F.lit((rank < STRING) == low)
    if low:
        return column >= F.lit(key) if inclusive else column > F.lit(key)
    return column <= F.lit(key) if inclusive else column < F.lit(key)


def id_range(column: Column, startkey: Any = UNSET, endkey: Any = UNSET, inclusive_end: bool = True, descending: bool = False) -> Column:
    """The predicate of a range given in traversal direction."""
    test = F.lit(True)
    if startkey is not UNSET:
        test = test & _bound(startkey, column, not descending)
    if endkey is not UNSET:
        test = test & _bound(endkey, column, descending, inclusive_end)
    return test


def _before_start(column: Column, startkey: Any, descending: bool) -> Column:
    return F.lit(False) if startkey is UNSET else ~_bound(startkey, column, not descending)


def _page(rows: DataFrame, order: list[Column], skip: int, limit: int | None) -> DataFrame:
    rows = rows.orderBy(*order)
    rows = rows.offset(skip) if skip else rows
    return rows.limit(limit) if limit is not None else rows


def all_docs(winners: DataFrame, startkey: Any = UNSET, endkey: Any = UNSET, *, key: Any = UNSET, inclusive_end: bool = True, descending: bool = False, skip: int = 0, limit: int | None = None, include_docs: bool = False, conflicts: bool = False, revs: DataFrame | None = None, scope: Column | None = None) -> Page:
    """Live documents in id order: id, key, rev, and doc and conflicts where asked for."""
    if key is not UNSET:
        startkey = endkey = key
    live = winners.where(~F.col("deleted"))
    live = live.where(scope) if scope is not None else live
    inside = live.where(id_range(F.col("id"), startkey, endkey, inclusive_end, descending))
    order = F.col("id").desc() if descending else F.col("id").asc()
    rows = _page(inside.select("id", "num", "hash"), [order], skip, limit)
    rows = rows.select("id", F.col("id").alias("key"), rev_text().alias("rev"), "num", "hash")
    if include_docs and revs is not None:
        own = revs.join(rows.select("id"), "id", "left_semi") if limit is not None else revs
        rows = R.with_bodies(rows, own).drop("atts").withColumnRenamed("body", "doc")
        if conflicts:
            rows = rows.join(R.conflicts(own), "id", "left")
        rows = rows.orderBy(order)
    total = live.agg(F.count("*").alias("total_rows"))
    before = live.agg((F.count_if(_before_start(F.col("id"), startkey, descending)) + F.lit(skip)).alias("offset"))
    return Page(rows.drop("num", "hash"), total, before)


def all_docs_keys(winners: DataFrame, keys: list[str], *, descending: bool = False, skip: int = 0, limit: int | None = None) -> Page:
    """Requested ids in request order, repeats kept; tombstones say deleted, unknown ids say not_found."""
    spark = winners.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos int, key string")
    met = asked.join(winners.select(F.col("id").alias("key"), "num", "hash", "deleted"), "key", "left")
    found = F.col("deleted").isNotNull()
    rows = met.select("pos", "key", F.when(found, F.col("key")).alias("id"), F.when(found, rev_text()).alias("rev"), F.when(F.col("deleted"), F.lit(True)).alias("deleted"), F.when(~found, F.lit("not_found")).alias("error"))
    order = F.col("pos").desc() if descending else F.col("pos").asc()
    return Page(_page(rows, [order], skip, limit), winners.where(~F.col("deleted")).agg(F.count("*").alias("total_rows")))


def batches(winners: DataFrame, queries: list[dict]) -> list[Page]:
    """Independent results of several scans, in order."""
    return [all_docs_keys(winners, **q) if "keys" in q else all_docs(winners, **q) for q in queries]


def design_docs(winners: DataFrame, **query: Any) -> Page:
    """Design documents only, with their own totals."""
    return all_docs(winners, scope=F.col("id").startswith("_design/"), **query)


def partition_docs(winners: DataFrame, partition: str, **query: Any) -> Page:
    """One partition, the ids that begin with it and a colon; the range lets the scan skip files."""
    inside = (F.col("id") >= f"{partition}:") & (F.col("id") < f"{partition};")
    return all_docs(winners, scope=inside, **query)


def live_scan(winners: DataFrame, after: str | None = None) -> DataFrame:
    """Live documents that aren't design documents, after an id, in id order."""
    rows = winners.where(~F.col("deleted") & ~F.col("id").startswith("_design/"))
    return (rows.where(F.col("id") > after) if after is not None else rows).orderBy("id")


def get(winners: DataFrame, revs: DataFrame, doc_id: str, rev: tuple[int, str] | None = None) -> DataFrame:
    """One row (id, num, hash, rev, deleted, body, atts): the winner, or any stored revision."""
    said = ["id", "num", "hash", rev_text().alias("rev"), "deleted", "body", "atts"]
    own = R.whole(revs).where(F.col("id") == doc_id)
    if rev is not None:
        return own.where((F.col("num") == rev[0]) & (F.col("hash") == rev[1])).select(*said)
    won = winners.where(F.col("id") == doc_id).select("id", "num", "hash")
    return own.join(won, ["id", "num", "hash"]).select(*said)


def get_many(winners: DataFrame, ids: DataFrame) -> DataFrame:
    """Winners, tombstones included, of the ids of a one-column table; missing ones are absent."""
    return winners.join(ids.select("id").distinct(), "id", "left_semi")


def bulk_get(winners: DataFrame, revs: DataFrame, wanted: DataFrame, revisions: bool = False) -> DataFrame:
    """(pos, id, num, hash, rev, body, atts, deleted, error) for wanted (pos, id, num, hash): the winner where num is null.

    ``revisions`` adds each one's ancestry.
    """
    won = winners.select("id", F.col("num").alias("wnum"), F.col("hash").alias("whash"))
    pinned = wanted.join(won, "id", "left").select("pos", "id", F.coalesce("num", "wnum").alias("num"), F.when(F.col("num").isNull(), F.col("whash")).otherwise(F.col("hash")).alias("hash"))
    met = pinned.join(R.whole(revs).select("id", "num", "hash", "deleted", "body", "atts"), ["id", "num", "hash"], "left")
    error = F.when(F.col("deleted").isNull(), F.struct(F.lit("not_found").alias("error"), F.lit("missing").alias("reason")))
    out = met.select("pos", "id", "num", "hash", F.when(F.col("deleted").isNotNull(), rev_text()).alias("rev"), "body", "atts", "deleted", error.alias("error"))
    return out.join(R.paths(revs, met.where("deleted is not null")), ["id", "num", "hash"], "left") if revisions else out


def local_docs(local: DataFrame, keys: list[str] | None = None, skip: int = 0, limit: int | None = None, include_docs: bool = False, descending: bool = False) -> DataFrame:
    """Local documents (id, n, body) in id order; keys are a filter, not an order."""
    rows = local.where(F.col("id").isin(keys)) if keys is not None else local
    rows = _page(rows, [F.col("id").desc() if descending else F.col("id").asc()], skip, limit)
    return rows.select("id", F.concat(F.lit("0-"), F.col("n").cast("string")).alias("rev"), *(["body"] if include_docs else []))


def all_dbs(databases: DataFrame, startkey: Any = UNSET, endkey: Any = UNSET, descending: bool = False, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Database names in byte order, bounds inclusive."""
    rows = databases.where(id_range(F.col("name"), startkey, endkey, True, descending)).select("name")
    return _page(rows, [F.col("name").desc() if descending else F.col("name").asc()], skip, limit)


def dbs_info(winners: DataFrame, names: list[str] | None = None, group: str = "db", size: Column | None = None) -> DataFrame:
    """Per database doc_count, doc_del_count, update_seq and size of live bodies, from winners with a name column."""
    rows = winners.where(F.col(group).isin(names)) if names is not None else winners
    size = F.lit(0) if size is None else size
    live = ~F.col("deleted")
    return rows.groupBy(group).agg(F.count_if(live).alias("doc_count"), F.count_if(~live).alias("doc_del_count"), F.max("seq").alias("update_seq"), F.coalesce(F.sum(F.when(live, size)), F.lit(0)).cast("bigint").alias("external_size"))


def partition_info(winners: DataFrame, size: Column | None = None) -> DataFrame:
    """The same by partition, for ids that have one."""
    rows = winners.where(F.col("id").contains(":")).withColumn("partition", F.substring_index("id", ":", 1))
    return dbs_info(rows, group="partition", size=size).drop("update_seq")


def db_events(events: DataFrame, since: int = 0) -> DataFrame:
    """created and deleted events after a sequence number."""
    return events.where(F.col("event_seq") > since).orderBy("event_seq")


def typed_winners(df: DataFrame, doc_id: Column, seq: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """A plain table as live, first-revision documents."""
    none = F.lit(False) if deleted is None else deleted
    return df.select(doc_id.cast("string").alias("id"), F.lit(1).alias("num"), F.lit("0" * 32).alias("hash"), none.alias("deleted"), (F.lit(None).cast("bigint") if seq is None else seq.cast("bigint")).alias("seq"), "*")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


assert ARRAY > STRING  # arrays and objects lie after all ids
