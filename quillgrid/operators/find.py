"""Declarative find: request checks, index choice, keyset bookmarks, explain."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import NotFound, QueryError
from quillgrid.functions.collation import KEY
from quillgrid.plans.compile import Row, Typed, Variant, compile_selector, field_of, project, project_json
from quillgrid.plans.selector import Doc, normalize, parse, ranges


@dataclass
class Find:
    """A request, with the defaults that clients know."""

    selector: dict
    limit: int = 25
    skip: int = 0
    sort: list = field(default_factory=list)
    fields: list[str] | None = None
    bookmark: str | None = None
    use_index: str | list[str] | None = None
    conflicts: bool = False
    execution_stats: bool = False
    update: bool = True
    strict: bool = False

    def __post_init__(self) -> None:
        if self.limit < 0 or self.skip < 0:
            raise QueryError("bad_request", "limit and skip must not be negative")
        self.order()

    def order(self) -> tuple[list[str], bool]:
        """(fields, descending): one direction for all."""
        pairs = [(x, "asc") if isinstance(x, str) else next(iter(x.items())) for x in self.sort]
        if len({d for _, d in pairs}) > 1:
            raise QueryError("unsupported_mixed_sort", "Sorts currently only support a single direction for all fields.")
        return [f for f, _ in pairs], bool(pairs) and pairs[0][1] == "desc"


@dataclass(frozen=True)
class IndexDef:
    ddoc: str
    name: str
    fields: tuple[str, ...]
    partial: str | None = None
    path: str | None = None

    def usable(self, constrained: set[str], sort: list[str]) -> bool:
        """All fields constrained, or the sort is the index's beginning; the rest of the key must be constrained."""
        if sort and list(self.fields[: len(sort)]) != [f for f in sort]:
            return False
        return set(self.fields) <= constrained | set(sort)


class IndexCatalog:
    """JSON indexes over one table: definitions, and sorted Parquet tables where a path is given."""

    def __init__(self, root: str | None = None):
        self.root, self.defs = root, {}

    def define(self, fields: list[str | dict], name: str | None = None, ddoc: str | None = None, partial: dict | None = None, kind: str = "json") -> tuple[str, IndexDef]:
        """created or exists, and the definition."""
        if kind != "json":
            raise QueryError("required index type is not available", kind, 503)
        names = tuple(x if isinstance(x, str) else next(iter(x)) for x in fields)
        if not names:
            raise QueryError("bad_request", "an index needs fields")
        said = hashlib.sha1(json.dumps([names, partial], sort_keys=True).encode()).hexdigest()
        name, ddoc = name or said, (ddoc or said).removeprefix("_design/")
        if partial is not None:
            parse(partial)
        made = IndexDef(ddoc, name, names, None if partial is None else json.dumps(partial), f"{self.root}/{ddoc}-{name}" if self.root else None)
        if self.defs.get((ddoc, name)) == made:
            return "exists", made
        self.defs[ddoc, name] = made
        return "created", made

    def create(self, docs: DataFrame, fields: list[str | dict], name: str | None = None, ddoc: str | None = None, partial: dict | None = None, kind: str = "json") -> str:
        """created, or exists."""
        answer, made = self.define(fields, name, ddoc, partial, kind)
        if answer == "created" and made.path:
            self.rows(docs, made).repartitionByRange(*made.fields).sortWithinPartitions(*made.fields).write.mode("overwrite").parquet(made.path)
        return answer

    def source(self, docs: DataFrame, index: IndexDef, node: Doc) -> DataFrame:
        """The documents that an index holds: a table as it was written, or a view of docs."""
        return docs.sparkSession.read.parquet(index.path) if index.path else self.rows(docs, index)

    @staticmethod
    def rows(docs: DataFrame, index: IndexDef) -> DataFrame:
        """What an index holds: documents with every field, and inside the partial selector."""
        doc = Row(docs)
        there = [v.present() if (v := field_of(doc, tuple(f.split(".")))) is not None else F.lit(False) for f in index.fields]
        rows = docs.where(_every(there))
        return rows.where(compile_selector(json.loads(index.partial), doc)) if index.partial else rows

    def list(self) -> list[dict]:
        """The special index first, then by (ddoc, name)."""
        special = {"ddoc": None, "name": "_all_docs", "type": "special", "def": {"fields": [{"_id": "asc"}]}}
        rest = [{"ddoc": f"_design/{d.ddoc}", "name": d.name, "type": "json", "def": {"fields": [{f: "asc"} for f in d.fields], **({"partial_filter_selector": json.loads(d.partial)} if d.partial else {})}} for _, d in sorted(self.defs.items())]
        return [special, *rest]

    def delete(self, ddoc: str, name: str) -> None:
        if self.defs.pop((ddoc.removeprefix("_design/"), name), None) is None:
            raise NotFound("index not found")

    def choose(self, request: Find, node: Doc) -> tuple[IndexDef | None, str | None]:
        """The index to read, and a warning. A partial index only on request: it omits documents."""
        constrained, (sort, _) = set(ranges(node)), request.order()
        each = sorted(self.defs.values(), key=lambda d: (d.ddoc, d.name))
        if request.use_index is not None:
            want = request.use_index if isinstance(request.use_index, list) else request.use_index.split("/", 1)
            named = [d for d in each if d.ddoc == want[0].removeprefix("_design/") and (len(want) < 2 or d.name == want[1])]
            for d in named:
                if d.usable(constrained, sort):
                    return d, None
            warning = f"{'/'.join(want)} was not used because it is not a valid index for this query."
        else:
            warning = None
        for d in each:
            if d.partial is None and d.usable(constrained, sort):
                return d, warning
        if sort and sort != ["_id"] and request.strict:
            raise QueryError("no_usable_index", "No index exists for this sort, try indexing by the sort fields.")
        return None, warning or "No matching index found, create an index to optimize query time."


def _every(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c
    return out


@dataclass
class Found:
    docs: DataFrame
    index: IndexDef | None
    warning: str | None
    request: Find
    matched: DataFrame
    keys: list[Column]
    source: DataFrame
    stats: Any = None

    def page(self) -> tuple[list[dict], str]:
        """The rows, which the request's limit bounds, and the bookmark after them."""
        named = [k.alias(f"__k{i}") for i, k in enumerate(self.keys)]
        rows = [r.asDict(recursive=True) for r in self.matched.select("*", *named).collect()]
        marks = [[r.pop(f"__k{i}") for i in range(len(named))] for r in rows]
        bookmark = encode_bookmark(marks[-1]) if marks else self.request.bookmark or "nil"
        docs = [r.asDict(recursive=True) for r in self.docs.collect()] if self.request.fields else rows
        return docs, bookmark


def _again(value: Any) -> Column:
    """A key of a bookmark as a constant; keys of JSON values are token lists."""
    if isinstance(value, list) and value and isinstance(value[0], dict):
        token = [F.struct(F.lit(t["r"]).alias("r"), F.lit(t["n"]).cast("double").alias("n"), F.lit(t["s"]).cast("string").alias("s")) for t in value]
        return F.array(*token).cast(KEY)
    return F.lit(value)


def encode_bookmark(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).decode().rstrip("=")


def decode_bookmark(text: str) -> list:
    try:
        return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as bad:
        raise QueryError("invalid_bookmark", f"Invalid bookmark value: {text}") from bad


def find(docs: DataFrame, request: Find | dict, doc_id: str = "_id", catalog: IndexCatalog | None = None, body: str | None = None, conflicts: DataFrame | None = None) -> Found:
    """Documents that match, sorted, after the bookmark, cut to the page and projected.

    Typed mode takes fields from docs' columns; with ``body``, a column of JSON text, variant mode looks into it.
    """
    request = request if isinstance(request, Find) else Find(**request)
    node = parse(request.selector)
    catalog = catalog or IndexCatalog()
    chosen, warning = catalog.choose(request, node)
    source = docs if chosen is None else catalog.source(docs, chosen, node)
    stats = None
    if request.execution_stats:
        stats = Observation()
        source = source.observe(stats, F.count(F.lit(1)).alias("total_docs_examined"))
    sort, descending = request.order()
    if body is not None:
        source = source.withColumn("__v", F.parse_json(body))
        doc: Any = Variant(F.col("__v"))
    else:
        doc = Row(source)
    match = source.where(compile_selector(node, doc))
    keys = []
    for path in [s for s in sort if s != doc_id]:
        value = field_of(doc, tuple(path.split(".")))
        if value is None:
            match = match.where(F.lit(False))
            continue
        match = match.where(value.present())
        plain = isinstance(value, Typed) and not isinstance(value.kind, (T.StructType, T.MapType))
        keys.append(value.col if plain else value.key())
    keys.append(F.col(doc_id))
    if request.bookmark and request.bookmark != "nil":
        after = F.struct(*[_again(v).alias(f"c{i}") for i, v in enumerate(decode_bookmark(request.bookmark))])
        at = F.struct(*[k.alias(f"c{i}") for i, k in enumerate(keys)])
        match = match.where(at < after if descending else at > after)
    order = [k.desc() if descending else k.asc() for k in keys]
    match = match.orderBy(*order)
    match = match.offset(request.skip) if request.skip else match
    match = match.limit(request.limit)
    if request.conflicts and conflicts is not None:
        match = match.join(conflicts.select(F.col("id").alias(doc_id), F.col("conflicts").alias("_conflicts")), doc_id, "left").orderBy(*order)
    matched = match.drop("__v") if body is not None else match
    out = matched
    if request.fields:
        extra = ["_conflicts"] if request.conflicts and conflicts is not None else []
        out = project(matched, [*request.fields, *extra]) if body is None else matched.withColumn(body, project_json(F.col(body), request.fields))
    return Found(out, chosen, warning, request, match, keys, source, stats)


def explain(docs: DataFrame, request: Find | dict, catalog: IndexCatalog | None = None, doc_id: str = "_id", body: str | None = None) -> dict:
    """The plan: chosen index, candidates, normal form, bounds, options and the physical plan."""
    request = request if isinstance(request, Find) else Find(**request)
    catalog = catalog or IndexCatalog()
    node = parse(request.selector)
    chosen, warning = catalog.choose(request, node)
    found = ranges(node)

    def bound(low: bool) -> list:
        out = []
        for name in chosen.fields if chosen else ["_id"]:
            r = found.get(name)
            edge = None if r is None else (r.eq,) if r.has_eq else (r.low if low else r.high)
            out.append(edge[0] if edge else None if low else "<MAX>")
        return out

    plan = find(docs, request, doc_id, catalog, body).docs._jdf.queryExecution().toString()
    return {
        "index": next(x for x in catalog.list() if x["name"] == (chosen.name if chosen else "_all_docs")),
        "candidates": [x["name"] for x in catalog.list()],
        "selector": normalize(request.selector),
        "range": {"start_key": bound(True), "end_key": bound(False)},
        "opts": {"limit": request.limit, "skip": request.skip, "sort": request.sort, "fields": request.fields or "all_fields", "bookmark": request.bookmark or "nil", "conflicts": request.conflicts},
        "warning": warning,
        "plan": plan,
    }


def with_stats(found: Found) -> tuple[DataFrame, Any, Any]:
    """The documents with observations of how many are returned and, if the request asks for execution_stats, examined:
    read from the index or table before the selector. Keys examined are those of the index, one for each document."""
    returned = Observation()
    return found.docs.observe(returned, F.count(F.lit(1)).alias("results_returned")), returned, found.stats
