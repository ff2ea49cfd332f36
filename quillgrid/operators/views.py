"""Map/reduce views.

A map is declared as emissions (key parts, value, condition) over a typed DataFrame, which compile to one projection
without a shuffle, or as a Python function over JSON documents, which runs vectorized. Either gives the same index
rows: view, part, id, seq, key (sortable tokens), key_json, value_json, and for declared maps the parts k0, k1, ...
and the value with their own types, which reductions group and sum natively.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import CodeType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import QueryError
from quillgrid.functions import collation as C
from quillgrid.operators import attachments as A
from quillgrid.operators import revisions as R
from quillgrid.operators.scan import UNSET, Page, _page
from quillgrid.session import apart, plain_unions
from quillgrid.sources.indextable import lead_test

MapFunction = Callable[[dict, Callable[[Any, Any], None]], None]
MOST_EMITS = 100_000


@dataclass
class Emit:
    """One emission: a key (one column, or a list for an array key), a value, and when it is made."""

    key: Column | list[Column]
    value: Column | None = None
    when: Column | None = None


@dataclass
class View:
    emits: list[Emit] | None = None
    map: MapFunction | None = None
    reduce: str | Callable | None = None


@dataclass
class ViewGroup:
    """The views of one design document share a signature and are built together."""

    views: dict[str, View]
    options: dict[str, Any] = field(default_factory=dict)
    library: dict[str, str] = field(default_factory=dict)

    def signature(self) -> str:
        """MD5 over what decides the rows: equal definitions share an index."""
        def said(v: View) -> Any:
            if v.map is not None:
                return code_said(v.map)
            return [[str(e.key), str(e.value), str(e.when)] for e in v.emits or []]

        text = json.dumps([{k: said(v) for k, v in self.views.items()}, self.options, self.library], sort_keys=True)
        return hashlib.md5(text.encode()).hexdigest()


def code_said(function: Callable) -> list:
    """What a Python function does, as JSON values that are the same in every process."""

    def of(code: CodeType) -> list:
        consts = [of(c) if isinstance(c, CodeType) else repr(sorted(c, key=repr)) if isinstance(c, frozenset) else repr(c) for c in code.co_consts]
        return [code.co_code.hex(), consts, list(code.co_names), list(code.co_varnames)]

    held = [repr(c.cell_contents) for c in function.__closure__ or ()]
    return [*of(function.__code__), repr(function.__defaults__), held]


class Index:
    """Rows of one view, and the types of declared key parts (None for JSON keys; one part for plain keys)."""

    def __init__(self, rows: DataFrame, parts: list[T.DataType] | None = None, array: bool = False, reduce: Any = None):
        self.rows, self.parts, self.array, self.reduce = rows, parts, array, reduce

    def part_names(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.parts or []))]


def json_of(c: Column) -> Column:
    """A column as JSON text; null is JSON null."""
    wrapped = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def build(docs: DataFrame, view: View, doc_id: str = "id", part: Column | None = None) -> Index:
    """The index of a declared map over typed documents."""
    if view.emits is None:
        return build_json(docs, view, doc_id)
    plain_unions(docs.sparkSession)
    frames, kinds, array = [], None, False
    for e in view.emits:
        array = isinstance(e.key, list)
        parts = e.key if array else [e.key]
        value = F.lit(None).cast("string") if e.value is None else e.value
        seq = F.col("seq") if "seq" in docs.columns else F.lit(None).cast("bigint")
        chosen = docs.where(e.when) if e.when is not None else docs
        one = chosen.select(F.col(doc_id).cast("string").alias("id"), seq.alias("seq"), (F.lit("") if part is None else part).alias("part"), *[p.alias(f"k{i}") for i, p in enumerate(parts)], value.alias("value"))
        kinds = [one.schema[f"k{i}"].dataType for i in range(len(parts))]
        frames.append(one)
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    named = list(zip([F.col(f"k{i}") for i in range(len(kinds))], kinds, strict=True))
    key = C.compound_key(named) if array else C.typed_key(*named[0])
    return Index(rows.withColumn("key", key), kinds, array, view.reduce)


_TOKEN = pa.struct([("r", pa.int32()), ("n", pa.float64()), ("s", pa.string())])
_ROWS = pa.schema([("id", pa.string()), ("seq", pa.int64()), ("part", pa.string()), ("key_json", pa.string()), ("value_json", pa.string()), ("key", pa.list_(_TOKEN))])
ROWS = "id string, seq bigint, part string, key_json string, value_json string, key array<struct<r:int,n:double,s:string>>"


def build_json(docs: DataFrame, view: View, doc_id: str = "id") -> Index:
    """The index of a Python map over JSON documents (id, seq, doc as text). A map that fails skips the document.

    Keys are taken apart where they are emitted; a key with a number beyond a double has no place and is left out.
    """
    run_map = view.map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, ends = [], [], [0]
            for i, seq, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = i.split(":", 1)[0] if ":" in i else ""
                for key, key_json, value_json in emitted(run_map, text):
                    try:
                        tokens += C.tokens(key)
                    except (ValueError, OverflowError):
                        del tokens[ends[-1] :]
                        continue
                    ends.append(len(tokens))
                    rows.append((i, seq, part, key_json, value_json))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            inner = list(zip(*tokens, strict=True)) or [[]] * 3
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(inner, _TOKEN, strict=True)], fields=list(_TOKEN)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=False)), keys], schema=_ROWS)

    seq = F.col("seq") if "seq" in docs.columns else F.lit(None).cast("bigint")
    rows = docs.select(F.col(doc_id).alias("id"), seq.cast("bigint").alias("seq"), "doc").mapInArrow(run, ROWS)
    return Index(rows.withColumn("key", F.col("key").cast(C.KEY)), None, False, view.reduce)


def emitted(run_map: MapFunction, text: str) -> list[tuple[Any, str, str]]:
    """What a map emits for a document: keys, and keys and values as JSON texts; nothing if it fails or emits too much."""
    found: list[tuple[Any, str, str]] = []

    def emit(key: Any = None, value: Any = None) -> None:
        if len(found) >= MOST_EMITS:
            raise OverflowError("too many emissions")
        text = json.dumps(key, ensure_ascii=False)
        found.append((key if key is None or isinstance(key, (bool, int, float, str)) else json.loads(text), text, json.dumps(value, ensure_ascii=False)))

    try:
        run_map(json.loads(text), emit)
    except Exception:  # noqa: BLE001  user code: isolated to its document and view
        return []
    return found


def refresh(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental build: rows of changed ids go, their new rows come."""
    plain_unions(old.sparkSession)
    return old.join(changed.select("id").distinct(), "id", "left_anti").unionByName(apart(new))


@dataclass
class ViewQuery:
    """Parameters of a view query; names as clients know them."""

    key: Any = UNSET
    keys: list | None = None
    startkey: Any = UNSET
    endkey: Any = UNSET
    startkey_docid: str | None = None
    endkey_docid: str | None = None
    inclusive_end: bool = True
    descending: bool = False
    skip: int = 0
    limit: int | None = None
    include_docs: bool = False
    conflicts: bool = False
    attachments: bool = False
    reduce: bool | None = None
    group: bool = False
    group_level: int | None = None
    partition: str | None = None
    update: str = "true"

    @classmethod
    def of(cls, body: dict | None = None, **params: Any) -> ViewQuery:
        """Merge a request body and query parameters: parameters win; start_key and the like are aliases."""
        names = {"start_key": "startkey", "end_key": "endkey", "start_key_doc_id": "startkey_docid", "end_key_doc_id": "endkey_docid", "stale": "update"}
        merged = {names.get(k, k): v for k, v in {**(body or {}), **params}.items()}
        merged["update"] = {"ok": "false", "update_after": "lazy"}.get(merged.get("update"), merged.get("update", "true"))
        return cls(**merged)

    def wants_reduce(self, reducer: Any) -> bool:
        return reducer is not None and self.reduce is not False

    def check(self, reducer: Any, partitioned: bool = False) -> None:
        bad = lambda reason: QueryError("query_parse_error", reason)
        grouped = self.group or self.group_level is not None
        if reducer is None and self.reduce:
            raise bad("Reduce is invalid for map-only views.")
        if grouped and not self.wants_reduce(reducer):
            raise bad("Invalid use of grouping on a map view.")
        if self.include_docs and self.wants_reduce(reducer):
            raise bad("`include_docs` is invalid for reduce")
        if self.keys is not None and (self.key is not UNSET or self.startkey is not UNSET or self.endkey is not UNSET):
            raise bad("`keys` is incompatible with `key`, `start_key` and `end_key`")
        if self.keys is not None and self.wants_reduce(reducer) and not self.group and len(self.keys) > 1:
            raise bad("Multi-key fetches for reduce views must use `group=true`")
        if self.skip < 0 or self.limit is not None and self.limit < 0:
            raise bad("`skip` and `limit` must not be negative")
        if self.startkey is not UNSET and self.endkey is not UNSET:
            order = _known_order(self.startkey, self.endkey)
            if order and (order > 0) != self.descending:
                raise bad("No rows can match your key range, reverse your start_key and end_key or set descending=" + ("false" if self.descending else "true"))
        if partitioned != (self.partition is not None):
            raise bad("`partition` parameter is mandatory for queries to this view." if partitioned else "`partition` parameter is not supported on this view")


def _known_order(a: Any, b: Any) -> int:
    """Order of two keys, 0 if it rests on two different strings, whose collation only Spark knows."""

    class Unknown(Exception):
        pass

    def strings(x: str, y: str) -> int:
        if x != y:
            raise Unknown
        return 0

    try:
        return C.compare(a, b, strings)
    except Unknown:
        return 0


def _reach(index: Index, q: ViewQuery) -> Column:
    """The predicate of key, range and document bounds. Plain typed keys compare natively, so they reach the scan."""
    test = F.lit(True) if q.partition is None else F.col("part") == F.lit(q.partition)
    if q.key is not UNSET:
        return test & _is_key(index, q.key)
    low, high = (q.endkey, q.startkey) if q.descending else (q.startkey, q.endkey)
    low_id, high_id = (q.endkey_docid, q.startkey_docid) if q.descending else (q.startkey_docid, q.endkey_docid)
    if low is not UNSET:
        test = test & _side(index, low, low_id, True, q.inclusive_end or not q.descending)
    if high is not UNSET:
        test = test & _side(index, high, high_id, False, q.inclusive_end or q.descending)
    return test


def _native(index: Index, value: Any) -> Column | None:
    """The part column to compare with, if the key is one number column and the value a number."""
    plain = index.parts is not None and not index.array and isinstance(index.parts[0], T.NumericType)
    return F.col("k0") if plain and C.rank_of(value) == C.NUMBER else None


def _is_key(index: Index, value: Any) -> Column:
    column = _native(index, value)
    if column is not None:
        return column == F.lit(value)
    return _plain(index, value, True) & _plain(index, value, False) & (F.col("key") == C.key_literal(value))


def _plain(index: Index, value: Any, low: bool) -> Column:
    """For stored rows what a bound says of their plain columns, which reaches the scan."""
    return lead_test(value, low) if "k_rank" in index.rows.columns else F.lit(True)


def _side(index: Index, value: Any, doc_id: str | None, low: bool, inclusive: bool) -> Column:
    column = _native(index, value)
    there, bound = (column, F.lit(value)) if column is not None else (F.col("key"), C.key_literal(value))
    if doc_id is not None:
        tied = (F.col("id") >= doc_id if inclusive else F.col("id") > doc_id) if low else (F.col("id") <= doc_id if inclusive else F.col("id") < doc_id)
        return _plain(index, value, low) & ((there > bound if low else there < bound) | ((there == bound) & tied))
    if low:
        return _plain(index, value, low) & (there >= bound if inclusive else there > bound)
    return _plain(index, value, low) & (there <= bound if inclusive else there < bound)


def _order(q: ViewQuery, index: Index) -> list[Column]:
    names = [*(["key"] if index.parts is None or index.array or not isinstance(index.parts[0], T.NumericType) else ["k0"]), "id"]
    return [F.col(n).desc() if q.descending else F.col(n).asc() for n in names]


def _scope(index: Index, q: ViewQuery) -> DataFrame:
    return index.rows if q.partition is None else index.rows.where(F.col("part") == q.partition)


def rows(index: Index, q: ViewQuery, winners: DataFrame | None = None, revs: DataFrame | None = None, blobs: DataFrame | None = None) -> Page:
    """Map rows in key order with totals and offset; with documents if asked for."""
    q.check(None, q.partition is not None)
    scope = _scope(index, q)
    total = scope.agg(F.count("*").alias("total_rows"))
    if q.keys is not None:
        page, order = _keyed(index, q), _keyed_order(q)
        first = scope.agg((F.count_if(F.col("key") < C.key_literal(q.keys[0])) if q.keys else F.lit(0)).alias("offset"))
        out = Page(page, total, first)
    else:
        inside, order = _reach(index, q), _order(q, index)
        picked = _page(scope.where(inside), order, q.skip, q.limit)
        before = _before(index, q)
        scalars = scope.agg((F.count_if(before) + F.least(F.lit(q.skip), F.count_if(inside))).alias("offset"))
        out = Page(picked, total, scalars)
    if q.include_docs and winners is not None:  # joins lose the order, so it is made again
        out.rows = linked_docs(out.rows, winners, revs, conflicts=q.conflicts, blobs=blobs if q.attachments else None).orderBy(*order)
    return out


def batches(index: Index, queries: list[ViewQuery], winners: DataFrame | None = None, revs: DataFrame | None = None) -> list[Page]:
    """Independent results of several queries, in order."""
    return [rows(index, q, winners, revs) for q in queries]


def _before(index: Index, q: ViewQuery) -> Column:
    start = q.key if q.key is not UNSET else q.startkey
    if start is UNSET:
        return F.lit(False)
    edge = ViewQuery(startkey=start, startkey_docid=q.startkey_docid, descending=q.descending)
    return ~_reach(index, edge)


def _keyed_order(q: ViewQuery) -> list[Column]:
    return [F.col("pos").desc(), F.col("id").desc()] if q.descending else [F.col("pos"), F.col("id")]


def _keyed(index: Index, q: ViewQuery) -> DataFrame:
    """Rows of the requested keys: request order, repeats kept, ids in order within a key."""
    if not q.keys:
        return index.rows.limit(0)
    spark, scope = index.rows.sparkSession, _scope(index, q)
    if all(_native(index, k) is not None for k in q.keys):  # numbers against a number column: an IN that reaches the scan
        lookup = spark.createDataFrame([(i, float(k)) for i, k in enumerate(q.keys)], "pos int, __k double")
        met = F.broadcast(lookup).join(scope.where(F.col("k0").isin(*q.keys)), F.col("__k") == F.col("k0").cast("double")).drop("__k")
    else:
        any_ = F.lit(False)
        for k in q.keys:
            any_ = any_ | (_plain(index, k, True) & _plain(index, k, False))
        lookup = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), C.key_literal(k).alias("key")) for i, k in enumerate(q.keys)])).alias("x")).select("x.*")
        met = F.broadcast(lookup).join(scope.where(any_), "key")  # the request's own size bounds it
    return _page(met, _keyed_order(q), q.skip, q.limit)


def linked_docs(rows_: DataFrame, winners: DataFrame, revs: DataFrame | None = None, value: str = "value_json", conflicts: bool = False, blobs: DataFrame | None = None) -> DataFrame:
    """Rows, in no order, with their document: a value's _id redirects to another document, its _rev pins a revision.

    ``conflicts`` adds the live losing leaves in rising order; attachments come as stubs, or with data from ``blobs``.
    """
    if value in rows_.columns:
        target, pinned = F.get_json_object(value, "$._id"), F.get_json_object(value, "$._rev")
    else:
        is_struct = isinstance(rows_.schema["value"].dataType, T.StructType)
        has = lambda n: is_struct and n in rows_.schema["value"].dataType.names
        target = F.col("value._id").cast("string") if has("_id") else F.lit(None).cast("string")
        pinned = F.col("value._rev") if has("_rev") else F.lit(None).cast("string")
    asked = rows_.withColumn("doc_id", F.coalesce(target, F.col("id"))).withColumn("__rev", pinned)
    live = winners.where(~F.col("deleted")).select(F.col("id").alias("doc_id"), F.concat_ws("-", "num", "hash").alias("doc_rev"), *(["doc"] if "doc" in winners.columns else []))
    if revs is None:
        return asked.join(live, "doc_id", "left").drop("__rev")
    bodies = R.whole(revs).where(~F.col("deleted"))
    bodies = A.with_data(bodies, blobs) if blobs is not None else bodies
    bodies = bodies.select(F.col("id").alias("doc_id"), F.concat_ws("-", "num", "hash").alias("doc_rev"), F.col("body").alias("doc"), F.col("atts").alias("attachments"))
    met = asked.join(live.select("doc_id", F.col("doc_rev").alias("__won")), "doc_id", "left").withColumn("doc_rev", F.coalesce("__rev", "__won"))
    met = met.join(bodies, ["doc_id", "doc_rev"], "left").drop("__rev", "__won")
    return met.join(R.conflicts(revs, False).withColumnRenamed("id", "doc_id"), "doc_id", "left") if conflicts else met
