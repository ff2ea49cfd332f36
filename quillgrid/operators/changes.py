"""The changes feed in batch: one row a document, after a sequence number, in its order."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.errors import QueryError
from quillgrid.operators import attachments as A
from quillgrid.operators import revisions as R
from quillgrid.operators.views import View, emitted
from quillgrid.plans.compile import Row, Variant, compile_selector


@dataclass
class ChangesQuery:
    since: int | str = 0
    limit: int | None = None
    descending: bool = False
    style: str = "main_only"
    include_docs: bool = False
    conflicts: bool = False
    attachments: bool = False
    doc_ids: list[str] | None = None
    filter: str | Callable | None = None
    selector: dict | None = None
    view: View | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def start(self, winners: DataFrame, current: int | None = None) -> int:
        """0, a number, ``N-opaque`` or now: the last sequence number given out, which purges may have outlived."""
        if self.since == "now":
            return current_seq(winners) if current is None else current
        text = str(self.since).split("-", 1)[0]
        if not text.isdigit():
            raise QueryError("bad_request", f"Malformed sequence supplied in since: {self.since}")
        return int(text)


@dataclass
class Changes:
    rows: DataFrame
    scanned: DataFrame
    winners: DataFrame
    query: ChangesQuery
    since: int
    test: Column | None = None

    def last_seq(self) -> int:
        """The last row scanned, also if a filter dropped it; the last row given where the limit cut."""
        if self.query.limit is not None:
            n, top = self.rows.agg(F.count("*"), F.max("seq")).first()
            if n >= self.query.limit:
                return self.since if top is None else top
        top = self.scanned.agg(F.max("seq")).first()[0]
        return self.since if top is None else top

    def pending(self) -> int:
        return pending(self.winners, self.last_seq())


def current_seq(winners: DataFrame) -> int:
    return winners.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def design_seq(winners: DataFrame) -> int:
    """The last change of a design document."""
    return current_seq(winners.where(F.col("id").startswith("_design/")))


def pending(winners: DataFrame, since: int) -> int:
    """Documents changed after a sequence number, whatever a filter says."""
    return winners.where(F.col("seq") > since).count()


def _test(winners: DataFrame, q: ChangesQuery) -> Column | None:
    name = q.filter
    if callable(name):
        @F.pandas_udf("boolean")
        def passes(docs: pd.Series) -> pd.Series:
            return docs.map(lambda text: _passes(name, text, q.params))

        return passes(document(winners))
    if name in ("_doc_ids", None) and q.doc_ids is not None:
        return F.col("id").isin(q.doc_ids)
    if name == "_design":
        return F.col("id").startswith("_design/")
    if name == "_selector":
        doc = Variant(F.parse_json(document(winners))) if "body" in winners.columns else Row(winners)
        return compile_selector(q.selector or {}, doc)
    if name == "_view":
        if q.view.emits is not None:
            test = F.lit(False)
            for e in q.view.emits:
                test = test | (F.coalesce(e.when, F.lit(False)) if e.when is not None else F.lit(True))
            return test
        run_map = q.view.map

        @F.pandas_udf("boolean")
        def maps(docs: pd.Series) -> pd.Series:
            return docs.map(lambda text: bool(emitted(run_map, text)))

        return maps(document(winners))
    if name is not None:
        raise QueryError("not_found", f"missing filter {name}", 404)
    return None


def _passes(test: Callable, text: str, params: dict) -> bool:
    try:
        return bool(test(json.loads(text), {"query": params}))
    except Exception:  # noqa: BLE001  user code: a filter that fails drops the document
        return False


def document(winners: DataFrame) -> Column:
    """The whole document as JSON text, with its id, revision and deletion."""
    head = F.to_json(F.struct(F.col("id").alias("_id"), F.concat_ws("-", F.col("num").cast("string"), "hash").alias("_rev"), F.when(F.col("deleted"), F.lit(True)).alias("_deleted")))
    body = F.trim(F.coalesce(F.col("body"), F.lit("{}")))
    joined = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(body, F.lit(2), F.length(body)))
    return F.when(F.regexp_like(body, F.lit(r"^\{\s*\}$")), head).otherwise(joined)


def changes(winners: DataFrame, query: ChangesQuery | None = None, revs: DataFrame | None = None, current: int | None = None, blobs: DataFrame | None = None) -> Changes:
    """Rows seq, id, deleted, changes (revisions) and, where asked for, doc, conflicts and attachments, by seq.

    Rows are cut to the limit first, what belongs to them is joined then, and the order is made last.
    """
    q = query or ChangesQuery()
    since = q.start(winners, current)
    scanned = winners.where(F.col("seq") > since)
    test = _test(winners, q)
    rows = scanned.where(test) if test is not None else scanned
    order = F.col("seq").desc() if q.descending else F.col("seq").asc()
    joined = revs is not None and (q.style == "all_docs" or q.include_docs)
    if q.limit is not None:
        rows = rows.orderBy(order).limit(q.limit)
    revision = F.concat_ws("-", F.col("num").cast("string"), F.col("hash"))
    out = rows.select("seq", "id", "deleted", F.array(revision).alias("changes"), *(["num", "hash"] if joined and q.include_docs else []))
    if joined:
        own = revs.join(out.select("id"), "id", "left_semi") if q.limit is not None else revs
        if q.style == "all_docs":
            out = out.drop("changes").join(R.all_leaves(own).withColumnRenamed("revs", "changes"), "id")
        if q.include_docs:
            out = R.with_bodies(out, own)
            if q.attachments and blobs is not None:
                out = A.with_data(out, blobs)
            out = out.withColumnsRenamed({"body": "doc", "atts": "attachments"}).drop("num", "hash")
            if q.conflicts:
                out = out.join(R.conflicts(own), "id", "left")
    return Changes(out if q.limit is not None and not joined else out.orderBy(order), scanned, winners, q, since, test)


def latest(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Compaction of a log of changes: the last row of each document."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")
