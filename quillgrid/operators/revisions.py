"""Revision trees as plans over the append-only table of revisions.

Columns: id, num, hash, parent_num, parent_hash, deleted, body (JSON text), seq, atts (JSON text of attachment stubs, or
null). A leaf is a revision without child; the winner of a document is its greatest leaf by (live before deleted, num,
hash). What needs a whole tree walks it inside one id (``by_document``): trees are bounded by the revision limit. Bodies
stay out of all this: keys are worked out first and bodies joined to what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgrid.functions.schema import struct
from quillgrid.session import apart, plain_unions

REVS = struct("id string, num int, hash string, parent_num int, parent_hash string, deleted boolean, body string, seq bigint, atts string")
KEY = ["id", "num", "hash"]
REVS_LIMIT = 1000


def whole(revs: DataFrame) -> DataFrame:
    """revs with the columns of REVS; those that it lacks are null."""
    return revs.select(*[F.col(f.name) if f.name in revs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in REVS.fields])


def _marked(revs: DataFrame) -> DataFrame:
    """(id, num, hash, deleted, seq, inner): each revision once, with whether it is some other's parent.

    A revision meets its children's mention of it in one aggregate. Rows are dealt by id, so what is grouped by id next
    needs no second shuffle. A revision that was appended twice counts once.
    """
    plain_unions(revs.sparkSession)
    own = revs.select(*KEY, "deleted", "seq", F.lit(False).alias("said"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("deleted", "boolean"), ("seq", "bigint"))]
    said = revs.where("parent_num is not null").select("id", F.col("parent_num").alias("num"), F.col("parent_hash").alias("hash"), *none, F.lit(True).alias("said"))
    met = own.unionByName(apart(said)).repartition("id").groupBy(*KEY)
    return met.agg(F.max("deleted").alias("deleted"), F.max("seq").alias("seq"), F.bool_or("said").alias("inner"), F.bool_and("said").alias("absent")).where("not absent").drop("absent")


def leaves(revs: DataFrame) -> DataFrame:
    """Revisions that no other has as its parent, whole."""
    said = revs.where("parent_num is not null").select("id", F.col("parent_num").alias("num"), F.col("parent_hash").alias("hash"))
    return whole(revs.join(said, KEY, "left_anti").dropDuplicates(KEY))


def leaf_keys(revs: DataFrame) -> DataFrame:
    """(id, num, hash, deleted, seq) of the leaves."""
    return _marked(revs).where("not inner").drop("inner")


def winners(revs: DataFrame, with_body: bool = False) -> DataFrame:
    """One row for each id: the winning revision, the document's seq and the number of leaves; its body and attachment
    stubs if asked for."""
    order = F.when(~F.col("inner"), F.struct((~F.col("deleted")).alias("live"), "num", "hash"))
    best = _marked(revs).groupBy("id").agg(F.max(order).alias("w"), F.count_if(~F.col("inner")).alias("leaves"), F.max("seq").alias("seq"))
    best = best.select("id", F.col("w.num").alias("num"), F.col("w.hash").alias("hash"), (~F.col("w.live")).alias("deleted"), "leaves", "seq")
    return with_bodies(best, revs).select("id", "num", "hash", "deleted", "body", "atts", "leaves", "seq") if with_body else best


def with_bodies(keys: DataFrame, revs: DataFrame, kind: str = "inner") -> DataFrame:
    """keys (one row for each id, num, hash at most) with the revision's body and attachment stubs.

    Dealt by id alone, as winners are, so that only bodies move.
    """
    held = whole(revs).select("id", F.struct("num", "hash").alias("__at"), "body", "atts")
    if kind == "inner":
        return keys.join(held, "id").where(F.col("__at") == F.struct("num", "hash")).drop("__at")
    return keys.join(whole(revs).select(*KEY, "body", "atts"), KEY, kind)


def documents(revs: DataFrame) -> DataFrame:
    """(id, num, hash, deleted, seq, conflicts, body, atts): winners with their conflicts (null if none), in one pass."""
    leaf = F.when(~F.col("inner"), F.struct((~F.col("deleted")).alias("live"), "num", "hash"))
    ranked = _marked(revs).groupBy("id").agg(F.sort_array(F.collect_list(leaf), False).alias("c"), F.max("seq").alias("seq"))
    rest = F.filter(F.slice("c", F.lit(2), F.size("c")), lambda x: x["live"])
    one = F.col("c")[0]
    keys = ranked.select("id", one["num"].alias("num"), one["hash"].alias("hash"), (~one["live"]).alias("deleted"), "seq", F.when(F.size(rest) > 0, _texts(rest)).alias("conflicts"))
    return with_bodies(keys, revs)


def _by_rank(revs: DataFrame) -> DataFrame:
    """(id, c): a document's leaves as (live, num, hash), the winner first."""
    return leaf_keys(revs).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((~F.col("deleted")).alias("live"), "num", "hash")), False).alias("c"))


def _texts(c: Column | str) -> Column:
    return F.transform(c, lambda x: F.concat_ws("-", x["num"].cast("string"), x["hash"]))


def conflicts(revs: DataFrame, descending: bool = True) -> DataFrame:
    """(id, conflicts): live leaves other than the winner, as text, by (num, hash)."""
    rest = _by_rank(revs).withColumn("c", F.filter(F.slice("c", F.lit(2), F.size("c")), lambda x: x["live"])).where(F.size("c") > 0)
    return rest.select("id", _texts("c" if descending else F.reverse("c")).alias("conflicts"))


def all_leaves(revs: DataFrame) -> DataFrame:
    """(id, revs): the winner first, then the other leaves, live ones first, each by (num, hash) descending."""
    return _by_rank(revs).select("id", _texts("c").alias("revs"))


CHAINS = struct("id string, leaf_num int, leaf_hash string, depth int, num int, hash string")


def ancestry(revs: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, leaf_num, leaf_hash, depth, num, hash): the parent chain of each start (id, num, hash), newest first.

    The whole chain, unless ``limit`` is given: only writes and compaction drop old revisions. A chain is walked inside
    its document's tree, so one shuffle does for any depth; a recursive query would take a job for each level.
    """

    def run(rows: list[dict]) -> Iterator[dict]:
        tree = Tree([r for r in rows if not r["asked"]])
        most = len(tree.rows) if limit is None else limit  # no chain is longer; one that runs in a circle ends
        for s in (r for r in rows if r["asked"]):
            for depth, at in zip(range(most), tree.chain((s["num"], s["hash"])), strict=False):
                yield {"id": s["id"], "leaf_num": s["num"], "leaf_hash": s["hash"], "depth": depth, "num": at[0], "hash": at[1]}

    asked = starts.select("id", "num", "hash").distinct()
    own = revs.select("id", "num", "hash", "parent_num", "parent_hash").join(asked.select("id").distinct(), "id", "left_semi")
    none = asked.select("id", "num", "hash", F.lit(None).cast("int").alias("parent_num"), F.lit(None).cast("string").alias("parent_hash"))
    both = own.withColumn("asked", F.lit(False)).unionByName(apart(none.withColumn("asked", F.lit(True))))
    return by_document(both, ["asked", "num", "hash"], run, CHAINS)


def missing_revs(revs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, num, hash) of ``wanted`` that the table lacks."""
    return wanted.select("id", "num", "hash").distinct().join(revs, ["id", "num", "hash"], "left_anti")


def revs_diff(revs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, missing, possible_ancestors): leaves below the highest missing generation could be ancestors."""
    text = F.concat_ws("-", F.col("num").cast("string"), F.col("hash"))
    lacking = missing_revs(revs, wanted).groupBy("id").agg(F.sort_array(F.collect_list(text)).alias("missing"), F.max("num").alias("top"))
    asked = lacking.select(F.col("id").alias("aid"), "top")
    older = leaf_keys(revs).join(asked, (F.col("id") == F.col("aid")) & (F.col("num") < F.col("top"))).groupBy("id").agg(F.sort_array(F.collect_list(text)).alias("possible_ancestors"))
    return lacking.drop("top").join(older, "id", "left")


def forced(revs: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table with ``incoming`` merged; revisions that are known already change nothing."""
    plain_unions(revs.sparkSession)
    return whole(revs).unionByName(apart(new_by_path(revs, incoming)))


def new_by_path(revs: DataFrame, incoming: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Revisions that the table lacks of ``incoming``: (id, path, deleted, body, seq, and atts), path newest first as
    structs (num, hash). Ancestors come without body. Columns ``also``, the same for all of a document, stay."""
    atts = F.col("atts") if "atts" in incoming.columns else F.lit(None).cast("string")
    each = incoming.select("id", "deleted", "body", atts.alias("atts"), "seq", *also, "path", F.posexplode("path").alias("at", "r"))
    parent = F.try_element_at("path", (F.col("at") + 2).cast("int"))
    new = each.select("id", F.col("r.num").alias("num"), F.col("r.hash").alias("hash"), parent["num"].alias("parent_num"), parent["hash"].alias("parent_hash"), (F.col("deleted") & (F.col("at") == 0)).alias("deleted"), F.when(F.col("at") == 0, F.col("body")).alias("body"), "seq", F.when(F.col("at") == 0, F.col("atts")).alias("atts"), *also)
    best = new.groupBy("id", "num", "hash").agg(F.max_by(F.struct("parent_num", "parent_hash", "deleted", "body", "seq", "atts", *also), F.struct(F.col("body").isNotNull(), F.col("parent_num").isNotNull(), "seq")).alias("b"))
    new = best.select("id", "num", "hash", "b.*").join(revs, ["id", "num", "hash"], "left_anti")
    return new.select(*REVS.names, *also)


def open_revs(revs: DataFrame, doc_id: str, wanted: list[tuple[int, str]] | None = None, latest: bool = False, with_path: bool = False) -> DataFrame:
    """Rows (rev, ok, body, deleted) of all leaves, or of listed revisions; ``latest`` answers with descendant leaves.

    ``with_path`` adds the revision's ancestry, newest first.
    """
    own = revs.where(F.col("id") == doc_id)
    if wanted is None:
        found = leaves(own).select("num", "hash", "body", "deleted")
    else:
        asked = revs.sparkSession.createDataFrame(wanted, "num int, hash string")
        if latest:
            tips = ancestry(own, leaf_keys(own)).select("num", "hash", "leaf_num", "leaf_hash")
            asked = asked.join(tips, ["num", "hash"], "left").select(F.coalesce("leaf_num", "num").alias("num"), F.coalesce("leaf_hash", "hash").alias("hash")).distinct()
        found = asked.join(own.select("num", "hash", "body", "deleted"), ["num", "hash"], "left")
    if with_path:
        chains = paths(own, found.where("deleted is not null").select(F.lit(doc_id).alias("id"), "num", "hash"))
        found = found.join(chains.drop("id"), ["num", "hash"], "left")
    return found.select(F.concat_ws("-", "num", "hash").alias("rev"), F.col("deleted").isNotNull().alias("ok"), "body", "deleted", *(["revisions"] if with_path else []))


def paths(revs: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, num, hash, revisions): each start's generation and the hashes of its ancestry, newest first."""
    chains = ancestry(revs, starts, limit).groupBy("id", "leaf_num", "leaf_hash").agg(F.sort_array(F.collect_list(F.struct("depth", "hash"))).alias("c"))
    return chains.select("id", F.col("leaf_num").alias("num"), F.col("leaf_hash").alias("hash"), F.struct(F.col("leaf_num").alias("start"), F.transform("c", lambda x: x["hash"]).alias("ids")).alias("revisions"))


class Tree:
    """The revision tree of one document, in memory."""

    def __init__(self, rows: list[dict]):
        self.rows = {(r["num"], r["hash"]): r for r in rows}
        self.parent = {k: (r["parent_num"], r["parent_hash"]) if r["parent_num"] is not None else None for k, r in self.rows.items()}

    def tips(self) -> list[tuple[int, str]]:
        inner = set(self.parent.values())
        return [k for k in self.rows if k not in inner]

    def chain(self, at: tuple[int, str] | None) -> Iterator[tuple[int, str]]:
        while at in self.rows:
            yield at
            at = self.parent[at]

    def winner(self) -> tuple[int, str] | None:
        return max(self.tips(), key=lambda k: (not self.rows[k]["deleted"], *k), default=None)

    def add(self, row: dict) -> None:
        at = (row["num"], row["hash"])
        self.rows[at] = row
        self.parent[at] = (row["parent_num"], row["parent_hash"]) if row["parent_num"] is not None else None


def by_document(df: DataFrame, order: list[str], run: Callable[[list[dict]], Iterable[dict]], schema: T.StructType, key: str = "id", most: int = 10_000) -> DataFrame:
    """Rows of each document, together and in order, through a Python function.

    One sort by id and one Python call a partition instead of one a document: most documents have a row or two.
    """
    plain_unions(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _, rows in groupby((r for b in batches for r in b.to_pylist()), itemgetter(key)):
            for row in run(list(rows)):
                out.append(row)
                if len(out) >= most:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(each, schema)


KEPT = struct("id string, num int, hash string, tip boolean")
LIGHT = [*KEY, "parent_num", "parent_hash"]


def stem(revs: DataFrame, limit: int = REVS_LIMIT) -> DataFrame:
    """Keep what is at most ``limit`` deep below some leaf; bodies of inner revisions go (compaction)."""

    def run(rows: list[dict]) -> Iterator[dict]:
        tree = Tree(rows)
        tips = tree.tips()
        kept = {k for tip in tips for _, k in zip(range(limit), tree.chain(tip), strict=False)}
        for k in kept:
            yield {"id": rows[0]["id"], "num": k[0], "hash": k[1], "tip": k in set(tips) if len(tips) > 1 else k == tips[0]}

    kept = by_document(revs.select(*LIGHT), ["num", "hash"], run, KEPT)
    met = whole(revs).join(kept, KEY)
    return whole(met.withColumn("body", F.when(F.col("tip"), F.col("body"))).withColumn("atts", F.when(F.col("tip"), F.col("atts"))))


def purged(revs: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, num, hash) of the revisions that a purge of leaves (id, num, hash) removes: those and the ancestors that only
    they have. What isn't a leaf, or becomes none, stays."""
    asked = requests.select(*KEY).distinct()

    def run(rows: list[dict]) -> Iterator[dict]:
        tree = Tree([r for r in rows if not r["gone"]])
        for r in rows:
            at = (r["num"], r["hash"]) if r["gone"] else None
            while at in tree.rows and at not in set(tree.parent.values()):
                yield {"id": r["id"], "num": at[0], "hash": at[1]}
                tree.rows.pop(at)
                at = tree.parent.pop(at)

    touched = revs.select(*LIGHT).join(asked.select("id").distinct(), "id", "left_semi").withColumn("gone", F.lit(False))
    marks = asked.select(*KEY, F.lit(None).cast("int").alias("parent_num"), F.lit(None).cast("string").alias("parent_hash"), F.lit(True).alias("gone"))
    return by_document(touched.unionByName(apart(marks)), ["gone", "num", "hash"], run, struct("id string, num int, hash string"))


def purge(revs: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove leaves (id, num, hash) with the ancestors that only they have; other revisions asked for stay."""
    return whole(revs).join(purged(revs, requests), KEY, "left_anti")


def prune_history(revs: DataFrame, limit: int = REVS_LIMIT) -> DataFrame:
    """Drop inner revisions whose generation is ``limit`` or more below the winner's."""
    inner = _marked(revs).where("inner").select(*KEY)
    old = inner.join(winners(revs).select("id", F.col("num").alias("wnum")), "id").where(F.col("num") <= F.col("wnum") - limit)
    return revs.join(old.select("id", "num", "hash"), ["id", "num", "hash"], "left_anti")
