"""Interactive and bulk writes.

A batch is dealt by id; inside an id its edits apply in request order, each seeing the earlier ones, so the work is
spread over documents. New revisions get dense sequence numbers after the table's last, in request order: a
single writer commits. The result is one outcome row for each edit and the revisions to append.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quillgrid.errors import QueryError
from quillgrid.functions.revid import next_rev, parse_rev
from quillgrid.functions.schema import struct
from quillgrid.operators.attachments import written
from quillgrid.operators.revisions import REVS, Tree, by_document
from quillgrid.session import apart

#: pos: place in the request; rev: the expected revision, or null; body: JSON text, with _attachments.
EDITS = struct("pos bigint, id string, rev string, deleted boolean, body string")
_BLOB = T.StructType([T.StructField("digest", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("data", T.BinaryType())])
OUTCOMES = T.StructType([*struct("pos bigint, id string, ok boolean, rev string, error string, reason string, num int, hash string, parent_num int, parent_hash string, deleted boolean, body string, atts string").fields, T.StructField("blobs", T.ArrayType(_BLOB))])

Validator = Callable[[dict, dict | None], tuple[str, str] | None]


def parse_document(text: str) -> tuple[dict, dict]:
    """(underscore members, body) of a document; members must be known and no string may hold NUL."""
    if "\\u0000" in text or "\x00" in text:
        raise QueryError("bad_request", "NUL is not allowed")
    doc = json.loads(text)
    if not isinstance(doc, dict):
        raise QueryError("bad_request", "Document must be a JSON object")
    known = {"_id", "_rev", "_deleted", "_attachments", "_revisions", "_revs_info", "_conflicts", "_deleted_conflicts", "_local_seq"}
    meta = {k: v for k, v in doc.items() if k.startswith("_")}
    if strange := sorted(set(meta) - known):
        raise QueryError("doc_validation", f"Bad special document member: {strange[0]}")
    if not isinstance(meta.get("_attachments", {}), dict):
        raise QueryError("bad_request", "_attachments must be a JSON object")
    if "_id" in meta and not isinstance(meta["_id"], str):
        raise QueryError("illegal_docid", "Document id must be a string")
    if "_id" in meta:
        check_id(meta["_id"])
    return meta, {k: v for k, v in doc.items() if not k.startswith("_")}


def check_id(doc_id: str) -> None:
    if not doc_id or doc_id.startswith("_") and not re.match("_design/.|_local/.", doc_id):
        raise QueryError("illegal_docid", "Only reserved document ids may start with underscore.")


def new_id(kind: str = "random", suffix: str = "") -> Column:
    """An id for each row: random; utc_random and utc_id (time first, so ids sort by time; utc_id ends in ``suffix``); or
    sequential (a random beginning and a number that rises with the rows)."""
    text = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    now = F.lpad(F.lower(F.hex(F.unix_micros(F.current_timestamp()))), 14, "0")
    if kind == "random":
        return text
    if kind == "utc_random":
        return F.concat(now, F.substring(text, 1, 18))
    if kind == "utc_id":
        return F.concat(now, F.lit(suffix))
    if kind == "sequential":
        return F.concat(F.lit(random_id()[:16]), F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0"))
    raise QueryError("bad_request", f"unknown algorithm {kind}")


def random_id() -> str:
    return uuid.uuid4().hex


def apply_edits(revs: DataFrame, edits: DataFrame, validate: Validator | None = None) -> DataFrame:
    """Outcomes of the edits: accepted ones carry their new revision, others conflict, not_found, forbidden, ...

    Bodies of stored revisions are read only for a validator, which sees the one before.
    """

    def run(rows: list[dict]) -> Iterator[dict]:
        tree = Tree([r for r in rows if r["pos"] is None])
        for r in rows:
            if r["pos"] is not None:
                yield _edit(tree, r, validate)

    touched = revs.join(edits.select("id").distinct(), "id", "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    body = F.col("body") if validate is not None else none("string")
    atts = F.col("atts") if "atts" in revs.columns else none("string")
    stored = touched.select("id", none("bigint").alias("pos"), none("string").alias("rev"), "num", "hash", "parent_num", "parent_hash", "deleted", body.alias("body"), atts.alias("atts"))
    asked = edits.select("id", "pos", "rev", none("int").alias("num"), none("string").alias("hash"), none("int").alias("parent_num"), none("string").alias("parent_hash"), "deleted", "body", none("string").alias("atts"))
    return by_document(stored.unionByName(apart(asked)), ["pos"], run, OUTCOMES)


def _edit(tree: Tree, e: dict, validate: Validator | None) -> dict:
    out = {"pos": e["pos"], "id": e["id"], "ok": False}
    won = tree.winner()
    live = won is not None and not tree.rows[won]["deleted"]
    try:
        check_id(e["id"])
        expected = parse_rev(e["rev"]) if e["rev"] is not None else None
        meta, body = parse_document(e["body"] or "{}")
    except (QueryError, ValueError) as bad:
        return out | {"error": getattr(bad, "error", "bad_request"), "reason": getattr(bad, "reason", str(bad))}
    deleted = bool(e["deleted"]) or bool(meta.get("_deleted"))
    if deleted and won is None:
        return out | {"error": "not_found", "reason": "missing"}
    if expected != won and not (expected is None and not live and not deleted):
        return out | {"error": "conflict", "reason": "Document update conflict."}
    if validate is not None:
        before = json.loads(tree.rows[won]["body"]) if live and tree.rows[won]["body"] else None
        if bad := validate({**body, "_id": e["id"], **({"_deleted": True} if deleted else {})}, before):
            return out | {"error": bad[0], "reason": bad[1]}
    raw, atts, blobs = json.dumps(body, ensure_ascii=False, separators=(",", ":")), {}, []
    if meta.get("_attachments"):
        try:
            atts, blobs = written(meta["_attachments"], tree.rows[won]["atts"] if won else None, (won[0] if won else 0) + 1)
        except QueryError as bad:
            return out | {"error": bad.error, "reason": bad.reason}
    num, digest = next_rev(deleted, won, raw, [(n, a["content_type"], a["digest"]) for n, a in atts.items()])
    row = {"id": e["id"], "num": num, "hash": digest, "parent_num": won[0] if won else None, "parent_hash": won[1] if won else None, "deleted": deleted, "body": raw, "atts": json.dumps(atts, ensure_ascii=False) if atts else None}
    tree.add(row)
    return out | row | {"ok": True, "rev": f"{num}-{digest}", "error": None, "reason": None, "blobs": blobs}


def new_revisions(outcomes: DataFrame, last_seq: int, run: int = 4096) -> DataFrame:
    """Rows to append, with dense sequence numbers in request order.

    Accepted edits are counted by runs of positions and numbered inside a run from the count before it, so no task
    sorts the whole batch.
    """
    ok = outcomes.where("ok").withColumn("run", F.floor(F.col("pos") / run))
    counts = ok.groupBy("run").agg(F.count("*").alias("n"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("run").orderBy("pos"))
    numbered = ok.withColumn("inside", inside).join(base, "run")
    return numbered.withColumn("seq", F.col("base") + F.col("inside") + F.lit(last_seq)).select(*REVS.names)


def numbered_ids(docs: DataFrame, last_seq: int, parts: int = 1024) -> DataFrame:
    """(id, seq): dense numbers for the distinct ids, counted by parts of a hash, so that no task numbers them all."""
    ids = docs.select("id").distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    counts = ids.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return ids.withColumn("inside", inside).join(base, "part").select("id", (F.col("base") + F.col("inside") + F.lit(last_seq)).alias("seq"))


def places(rows: DataFrame, parts: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1, by (parts, order); the same for what is alike there. Each part is numbered by
    itself and moved on by the rows of those before it, so that no task numbers them all."""
    counts = rows.groupBy(*parts).agg(F.count("*").alias("__n"))
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*parts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.rank().over(Window.partitionBy(*parts).orderBy(*order))
    return rows.withColumn(name, inside).join(base, parts).withColumn(name, F.col(name) + F.col("__base")).drop("__base")


FLAGGED = struct("pos bigint, id string, growth bigint, accepted boolean")


def limit_partitions(edits: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Edits (pos, id, growth) with a flag: the one that crosses a partition's limit passes, later growth doesn't.

    A fold in request order within a partition, because rejected edits don't count. Rows stream through it in order with
    one number kept, so a partition of any size takes constant memory; its rows are positions and sizes of one request.
    ``sizes`` has (part, size).
    """
    arrow = to_arrow_schema(FLAGGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, total = r["part"], r["size"] or 0
                fits = r["growth"] <= 0 or total <= most
                total += r["growth"] if fits else 0
                rows.append({"pos": r["pos"], "id": r["id"], "growth": r["growth"], "accepted": fits})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    dealt = edits.withColumn("part", F.substring_index("id", ":", 1)).join(sizes, "part", "left").select("part", "pos", "id", "growth", "size")
    return dealt.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(run, FLAGGED)


def upsert_local(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Local documents (id, n, body): the batch always wins and counts up; revision 0-n."""
    new = batch.select("id", F.col("body").alias("new"))
    both = stored.join(new, "id", "full")
    return both.select("id", (F.coalesce("n", F.lit(0)) + F.when(F.col("new").isNotNull(), 1).otherwise(0)).alias("n"), F.coalesce("new", "body").alias("body"))
