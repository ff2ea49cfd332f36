"""Design documents: named views, filters, validators, updates, shows and lists, and the catalog of built indexes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.errors import NotFound
from quillgrid.operators import reduce as RD
from quillgrid.operators import revisions as R
from quillgrid.operators.scan import Page
from quillgrid.operators.views import Index, View, ViewGroup, ViewQuery, build_json, rows
from quillgrid.sources.folder import Folder
from quillgrid.sources.indexes import touched
from quillgrid.sources.indextable import IndexTable
from quillgrid.sources.store import Store


@dataclass
class DesignDoc:
    """A registry of user code; Python callables stand where a server would take source text.

    Filters are (doc, request) to bool, validators (new, old) to an error or None, updates (doc, request) to (doc or
    None, answer), shows (doc, request) to text, lists (head, request, rows) to an iterator of text.
    """

    name: str
    views: dict[str, View] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)
    filters: dict[str, Callable] = field(default_factory=dict)
    updates: dict[str, Callable] = field(default_factory=dict)
    shows: dict[str, Callable] = field(default_factory=dict)
    lists: dict[str, Callable] = field(default_factory=dict)
    validate: Callable[[dict, dict | None], tuple[str, str] | None] | None = None

    def group(self) -> ViewGroup:
        for v in self.views.values():
            if isinstance(v.reduce, str):
                RD.builtin_name(v.reduce)
        return ViewGroup(self.views, self.options)


def validators(ddocs: list[DesignDoc]) -> Callable[[dict, dict | None], tuple[str, str] | None]:
    """All validators run; the first objection counts."""

    def run(new: dict, old: dict | None) -> tuple[str, str] | None:
        return next((bad for d in ddocs if d.validate and (bad := d.validate(new, old))), None)

    return run


def map_input(store: Store, changed: DataFrame | None = None, options: dict | None = None) -> DataFrame:
    """(id, seq, doc) of live documents, all or those of some ids, as maps see them: with id, revision, attachment stubs,
    conflicts and, if asked for, their sequence."""
    options, revs = options or {}, store.revs()
    own = revs if changed is None else revs.join(changed.select("id"), "id", "left_semi")
    live = R.documents(own).where(~F.col("deleted"))
    if not options.get("include_design"):
        live = live.where(~F.col("id").startswith("_design/"))
    head = F.struct(F.col("id").alias("_id"), F.concat_ws("-", F.col("num").cast("string"), "hash").alias("_rev"), F.col("conflicts").alias("_conflicts"), *([F.col("seq").alias("_local_seq")] if options.get("local_seq") else []))
    inner = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)  # noqa: E731  what is between an object's braces
    body = F.trim(F.coalesce("body", F.lit("{}")))
    parts = [inner(F.to_json(head)), F.when(F.col("atts").isNotNull(), F.concat(F.lit('"_attachments":'), "atts")), F.when(~F.regexp_like(body, F.lit(r"^\{\s*\}$")), inner(body))]
    return live.select("id", "seq", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("doc"))


class ViewCatalog:
    """Built indexes below a folder, one per signature: rows of JSON documents, up to a sequence and a purge number."""

    def __init__(self, store: Store, root: str):
        self.store, self.root, self.ddocs, self.later = store, root.rstrip("/"), {}, set()

    def register(self, ddoc: DesignDoc) -> str:
        self.ddocs[ddoc.name] = ddoc
        return ddoc.group().signature()

    def _table(self, ddoc: str, view: str) -> IndexTable:
        signature = self._ddoc(ddoc).group().signature()
        return IndexTable(self.store.spark, f"{self.root}/{signature}/{view}")

    def _ddoc(self, name: str) -> DesignDoc:
        if name not in self.ddocs:
            raise NotFound("missing")
        return self.ddocs[name]

    def sync(self, ddoc: str) -> int:
        """Bring all views of a design document up to date; the sequence number reached.

        What was written or purged since the last time is mapped again: a purge changes winners without a number.
        """
        d, now = self._ddoc(ddoc), self.store.snapshot()
        for name, view in d.views.items():
            table = self._table(ddoc, name)
            built, (seq, purge) = bool(table.folder.parts()), table.reached()
            if built and (seq, purge) == (now.seq, now.purge):
                continue
            changed = touched(self.store, seq, purge) if built else None
            table.update(changed, build_json(map_input(self.store, changed, d.options), view).rows, now.seq, now.purge)
        self.later.discard(ddoc)
        return now.seq

    def index(self, ddoc: str, view: str, update: str = "true") -> Index:
        """The rows of a view; update builds first (true), not at all (false), or notes it for later (lazy)."""
        d = self._ddoc(ddoc)
        if view not in d.views:
            raise NotFound("missing_named_view")
        if update == "true":
            self.sync(ddoc)
        elif update == "lazy":
            self.later.add(ddoc)
        found = self._table(ddoc, view).read()
        if found is None:
            found = build_json(map_input(self.store).limit(0), d.views[view]).rows
        return Index(found, None, False, d.views[view].reduce)

    def queries(self, ddoc: str, view: str, queries: list[ViewQuery]) -> list[Page | DataFrame]:
        """Independent results of several queries of one view, in order."""
        return [self.query(ddoc, view, q) for q in queries]

    def query(self, ddoc: str, view: str, q: ViewQuery | None = None) -> Page | DataFrame:
        q = q or ViewQuery()
        index = self.index(ddoc, view, q.update)
        reducer = index.reduce if q.wants_reduce(index.reduce) else None
        q.check(reducer, bool(self._ddoc(ddoc).options.get("partitioned")))
        if reducer is not None:
            return RD.reduce_rows(index, q)
        if not q.include_docs:
            return rows(index, q)
        return rows(index, q, self.store.winners(), self.store.revs(), self.store.blobs() if q.attachments else None)

    def run_later(self) -> None:
        for name in list(self.later):
            self.sync(name)

    def info(self, ddoc: str) -> dict:
        """Signature, numbers reached by all views, and sizes: of the files, and of those that are read."""
        d = self._ddoc(ddoc)
        tables = [self._table(ddoc, v) for v in d.views]
        reached = [t.reached() for t in tables] or [(0, 0)]
        sizes = {"file": sum(t.folder.size() for t in tables), "active": sum(t.active_size() for t in tables)}
        return {"signature": d.group().signature(), "language": "python", "update_seq": min(r[0] for r in reached), "purge_seq": min(r[1] for r in reached), "sizes": sizes, "waiting": ddoc in self.later}

    def cleanup(self) -> list[str]:
        """Delete the indexes that no design document names any more."""
        folder = Folder(self.store.spark, self.root)
        used = {d.group().signature() for d in self.ddocs.values()}
        gone = [n for n in folder.names() if n not in used]
        for n in gone:
            folder.at(n).delete()
        return gone

    # user code over documents and rows

    def update(self, ddoc: str, name: str, doc_id: str | None, request: dict) -> tuple[str | None, Any]:
        """(revision or None, answer) of an update function."""
        old = None
        if doc_id is not None:
            try:
                old = self.store.get(doc_id)
            except NotFound:
                old = None
        new, answer = self._ddoc(ddoc).updates[name](old, request)
        return (self.store.put(new) if new is not None else None), answer

    def show(self, ddoc: str, name: str, doc_id: str | None, request: dict) -> str:
        return self._ddoc(ddoc).shows[name](self.store.get(doc_id) if doc_id else None, request)

    def list(self, ddoc: str, name: str, view: str, request: dict, q: ViewQuery | None = None) -> Iterator[str]:
        """A list function over a view's rows, which come one by one."""
        found = self.query(ddoc, view, q)
        frame = found.rows if isinstance(found, Page) else found
        head = {"total_rows": found.total_rows(), "offset": found.offset()} if isinstance(found, Page) else {}

        def each() -> Iterator[dict]:
            for r in frame.toLocalIterator():
                row = r.asDict()
                yield {"id": row.get("id"), "key": json.loads(row["key_json"]) if row.get("key_json") else None, "value": json.loads(row["value_json"]) if "value_json" in row else row.get("value")}

        yield from self._ddoc(ddoc).lists[name](head, request, each())

