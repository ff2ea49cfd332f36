"""JSON indexes of a store: covering rows of documents in key order, refreshed from the log before they are read."""

from __future__ import annotations

import hashlib
import json
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import collation as C
from quillgrid.operators.find import IndexCatalog, IndexDef
from quillgrid.plans.compile import Variant, compile_selector, field_of
from quillgrid.plans.selector import Doc, ranges
from quillgrid.sources.indextable import IndexTable, between, json_array, prefix_bounds

if TYPE_CHECKING:
    from quillgrid.sources.store import Store

DEFS = "ddoc string, name string, fields array<string>, partial string"


class StoreIndexes(IndexCatalog):
    """The catalog of a store's indexes. Definitions are kept in its folder; rows hold the whole documents."""

    def __init__(self, store: Store):
        super().__init__()
        self.store, self.folder = store, store.folder.at("indexes")
        parts = self.folder.at("defs").parts()
        if parts:
            for r in store.spark.read.schema(DEFS).parquet(f"{self.folder.path}/defs/{parts[-1]['path']}").collect():
                self.defs[r["ddoc"], r["name"]] = IndexDef(r["ddoc"], r["name"], tuple(r["fields"]), r["partial"])

    def create(self, fields: list[str | dict], name: str | None = None, ddoc: str | None = None, partial: dict | None = None, kind: str = "json") -> str:  # type: ignore[override]
        """created, or exists; rows are made when a query first reads them."""
        answer = self.define(fields, name, ddoc, partial, kind)[0]
        if answer == "created":
            self._keep()
        return answer

    def delete(self, ddoc: str, name: str) -> None:
        path = self._path(self.defs[ddoc.removeprefix("_design/"), name]) if (ddoc.removeprefix("_design/"), name) in self.defs else None
        super().delete(ddoc, name)
        self._keep()
        if path:
            IndexTable(self.store.spark, path).folder.delete()

    def _keep(self) -> None:
        at = self.folder.at("defs")
        parts = at.parts()
        rows = [(d.ddoc, d.name, list(d.fields), d.partial) for d in self.defs.values()]
        at.write(self.store.spark.createDataFrame(rows, DEFS), n=parts[-1]["n"] + 1 if parts else 1)

    def _path(self, index: IndexDef) -> str:
        said = json.dumps([index.fields, index.partial])
        return f"{self.folder.path}/rows/{index.ddoc}-{index.name}-{hashlib.sha1(said.encode()).hexdigest()[:12]}"

    def rows(self, docs: DataFrame, index: IndexDef) -> DataFrame:  # type: ignore[override]
        """Documents (id, num, hash, body, seq) with every field, and inside the partial selector, with their key."""
        doc: Any = Variant(F.col("__v"))
        parsed = docs.withColumn("__v", F.parse_json("body"))
        values = [field_of(doc, tuple(f.split("."))) for f in index.fields]
        test = F.lit(True)
        for v in values:
            test = test & v.present()
        if index.partial:
            test = test & compile_selector(json.loads(index.partial), doc)
        keyed = parsed.where(test).withColumn("key", C.json_key(json_array([F.to_json(v.col) for v in values]), True))
        return keyed.where("key is not null").drop("__v")

    def refresh(self, index: IndexDef) -> DataFrame:
        """The index's rows, brought up to the store's last write and purge."""
        store, table = self.store, IndexTable(self.store.spark, self._path(index))
        now, (seq, purge) = store.snapshot(), table.reached()
        if not table.folder.parts() or (seq, purge) != (now.seq, now.purge):
            changed = touched(store, seq, purge) if table.folder.parts() else None
            table.update(changed, self.rows(live_of(store, changed), index), now.seq, now.purge)
        return table.read()

    def source(self, docs: DataFrame, index: IndexDef, node: Doc) -> DataFrame:
        rows = self.refresh(index)
        low, high, bounded = prefix_bounds(index.fields, ranges(node))
        rows = rows.where(between(low, high)) if bounded else rows
        return rows.select(F.col("id").alias("_id"), "num", "hash", "body", "seq")


def touched(store: Store, seq: int, purge: int) -> DataFrame:
    """Ids that were written or purged after these numbers; the sequence reaches the scan."""
    return store.revs().where(F.col("seq") > seq).select("id").union(store.purged_since(purge).select("id")).distinct()


def live_of(store: Store, changed: DataFrame | None) -> DataFrame:
    """(id, num, hash, body, seq, atts) of live documents, all of them or those of some ids."""
    from quillgrid.operators import revisions as R

    revs = store.revs()
    own = revs if changed is None else revs.join(changed.select("id"), "id", "left_semi")
    return R.winners(own, True).where("not deleted and not startswith(id, '_design/')").select("id", "num", "hash", "body", "seq")
