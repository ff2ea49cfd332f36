"""View reductions: built-in ones as native aggregates, user functions folded by partition and rereduced.

Grouping is by hash, not by adjacency: cutting a key to its first elements keeps the order, so both give the same
groups. Declared keys group by their typed parts, JSON keys by their sortable key; the key shown is that of the
smallest id. Partial aggregation runs before the shuffle, so a hot group costs one row a task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from quillgrid.errors import QueryError
from quillgrid.functions import collation as C
from quillgrid.functions.schema import struct
from quillgrid.operators.views import Index, ViewQuery, _keyed, _page, _reach, json_of

BUILTIN = ("_approx_count_distinct", "_bottom_", "_count", "_first", "_last", "_stats", "_sum", "_top_")
#: Rows that a user's function gets at once, tasks that rereduce a group's parts, groups that a task holds.
CHUNK, SALTS, MOST_GROUPS = 1000, 32, 50_000


def builtin_name(name: str) -> tuple[str, int]:
    """The built-in reducer that a name begins with, and N of _top_N and _bottom_N (1 to 100)."""
    for known in BUILTIN:
        if name.startswith(known):
            if not known.endswith("_"):
                return known, 0
            m = re.match("[0-9]+", name[len(known) :])
            if m and 1 <= int(m[0]) <= 100:
                return known.rstrip("_"), int(m[0])
    raise QueryError("invalid_design_doc", f"`{name}` is not a supported reduce function.")


def reduce_rows(index: Index, q: ViewQuery, exact: bool = True) -> DataFrame:
    """One row for each group: its key columns and value; no row at all for an empty range.

    Key columns are the kept parts of declared keys (k0, ...), or key_json. Rows come in key order.
    """
    reducer = index.reduce
    q.check(reducer, q.partition is not None)
    if q.keys is not None:
        rows = _keyed(index, ViewQuery(keys=q.keys, partition=q.partition))
    else:
        rows = index.rows.where(_reach(index, q))
    rows, by, shown = _grouped(index, rows, q)
    if q.keys is not None and q.group:
        by = ["pos", *by]
    out = _apply(index, rows, by, reducer, exact)
    if not by:
        return out
    order = ["pos"] if "pos" in by else [c for c in by if c != "gkey"] if index.parts is not None else ["gkey"]
    cols = [F.col(c).desc() if q.descending else F.col(c).asc() for c in order]
    return _page(out, cols, q.skip, q.limit).drop("gkey", "pos")


def _grouped(index: Index, rows: DataFrame, q: ViewQuery) -> tuple[DataFrame, list[str], str | None]:
    """Rows with their group columns; none for a whole-range reduction."""
    level = None if q.group else q.group_level
    if not q.group and level is None:
        return rows, [], None
    if index.parts is not None:
        names = index.part_names()
        if index.array and level is not None:
            names = names[:level]
            if not names:
                return rows.withColumn("k", F.lit("[]")), ["k"], None
        return rows, names, None
    if level is None:
        return rows.withColumn("gkey", F.col("key")), ["gkey"], "key_json"
    cut = rows.withColumn("key_json", _truncated(F.col("key_json"), F.lit(level)))
    return cut.withColumn("gkey", C.json_key(F.col("key_json"))), ["gkey"], "key_json"


@F.pandas_udf(T.StringType())
def _truncated(keys: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(C.truncate(json.loads(k), int(n)), ensure_ascii=False) for k, n in zip(keys, levels, strict=True)])


def _number(index: Index) -> Column:
    """The value as a double; anything else is an error of the built-in reducers."""
    if index.parts is not None:
        return F.col("value").cast("double")
    v = F.try_parse_json("value_json")
    shape = F.schema_of_variant(v)
    fine = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    return F.when(fine, F.try_variant_get(v, "$", "double")).otherwise(F.raise_error(F.concat(F.lit("builtin_reduce_error: not a number: "), "value_json")).cast("double"))


def _order(index: Index) -> Column:
    return F.struct("k0", "id") if index.parts is not None and not index.array else F.struct("key", "id")


def _shown(index: Index, by: list[str]) -> list[Column]:
    return [F.min_by("key_json", "id").alias("key_json")] if "gkey" in by and index.parts is None else []


def _apply(index: Index, rows: DataFrame, by: list[str], reducer: Any, exact: bool) -> DataFrame:
    value = "value" if index.parts is not None else "value_json"
    if callable(reducer):
        return _user(index, rows, by, reducer)
    name, n = builtin_name(reducer)
    shown = _shown(index, by)
    if name == "_sum" and (index.parts is None or isinstance(rows.schema[value].dataType, T.ArrayType)):
        return _vector_sum(index, rows, by)
    if name in ("_top", "_bottom"):
        return _extremes(index, rows, by, value, n, name == "_top")
    if name == "_count":
        agg = [F.count("*").alias("value")]
    elif name == "_sum":
        agg = [F.sum(_number(index)).alias("value")]
    elif name == "_stats":
        x = _number(index)
        agg = [F.struct(F.sum(x).alias("sum"), F.count("*").alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x * x).alias("sumsqr")).alias("value")]
    elif name == "_approx_count_distinct":
        keys = F.struct(*index.part_names()) if index.parts is not None else F.col("key")
        agg = [(F.count_distinct(keys) if exact else F.approx_count_distinct(F.xxhash64(keys.cast("string")))).alias("value")]
    else:
        pick = F.min_by if name == "_first" else F.max_by
        agg = [pick(F.struct(F.col(value).alias("v")), _order(index))["v"].alias("value")]
    out = rows.groupBy(*by).agg(*shown, *agg, F.count("*").alias("__n"))
    return out.where("__n > 0").drop("__n")


def _vector_sum(index: Index, rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums by position: ragged arrays keep the longer tail, plain numbers add to position 0."""
    if index.parts is not None:
        parts, is_array = F.col("value").cast("array<double>"), F.lit(True)
    else:
        v = F.try_parse_json("value_json")
        is_array = F.schema_of_variant(v).startswith("ARRAY")
        parts = F.when(is_array, F.try_variant_get(v, "$", "array<double>")).otherwise(F.array(_number(index)))
        parts = F.when(is_array & parts.isNull(), F.raise_error(F.concat(F.lit("builtin_reduce_error: "), "value_json")).cast("array<double>")).otherwise(parts)
    each = rows.withColumn("__array", is_array)
    groups = each.groupBy(*by).agg(*_shown(index, by), F.bool_or("__array").alias("__array"), F.count("*").alias("__n")).where("__n > 0")
    sums = each.select(*by, F.posexplode(parts).alias("__at", "__x")).groupBy(*by, "__at").agg(F.sum("__x").alias("__x"))
    sums = sums.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__x"))), lambda s: s["__x"]).alias("sums"))
    met = groups.join(sums, by, "left") if by else groups.crossJoin(F.broadcast(sums))  # one row each
    array = F.coalesce("sums", F.array().cast("array<double>"))
    if index.parts is not None:
        return met.withColumn("value", array).drop("sums", "__array", "__n")
    return met.withColumn("value", F.when(F.col("__array"), F.to_json(array)).otherwise(C.rendered(array[0]))).drop("sums", "__array", "__n")


def _extremes(index: Index, rows: DataFrame, by: list[str], value: str, n: int, top: bool) -> DataFrame:
    """The N greatest or smallest distinct values, greatest (smallest) first."""
    kind = rows.schema[value].dataType
    order = C.typed_key(F.col(value), kind) if index.parts is not None and not isinstance(kind, T.NumericType) else F.col(value) if index.parts is not None else C.json_key(F.col(value))
    each = rows.withColumn("__o", order).groupBy(*by, "__o").agg(*_shown(index, by), F.min(value).alias("__v"))
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    column = F.col("__o").desc() if top else F.col("__o").asc()
    kept = each.withColumn("__r", F.row_number().over(window.orderBy(column))).where(F.col("__r") <= n)
    shown = [F.first("key_json").alias("key_json")] if _shown(index, by) else []
    out = kept.groupBy(*by).agg(*shown, F.transform(F.sort_array(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]).alias("value"), F.count("*").alias("__n"))
    return out.where("__n > 0").drop("__n")


def _user(index: Index, rows: DataFrame, by: list[str], reducer: Callable) -> DataFrame:
    """A function (keys, values, rereduce): chunks inside each partition, then rereductions in two steps.

    A partition folds its rows as they come and gives one part a group, so a hot group is the work of all partitions. Its
    parts are rereduced by ``SALTS`` tasks and those by one; parts are as small as the reduction makes them.

    Rows: the group's columns (or key_json), value as JSON text, and error where the reduction shrinks too little.
    """
    plain = [c for c in by if c != "gkey"]
    if index.parts is None:
        key, value = F.col("key_json"), F.col("value_json")
        head = F.col("key_json") if by else F.lit("null")
    else:
        value = json_of(F.col("value"))
        key = F.to_json(F.array(*[F.col(c).cast("string") for c in index.part_names()])) if index.array else json_of(F.col("k0"))
        head = F.lit("null")
    each = rows.select(*plain, "id", key.alias("key_text"), value.alias("value_text"), head.alias("head"))
    schema = T.StructType([*(rows.schema[c] for c in plain), *struct("first_id string, head string, part string, size bigint, salt int").fields])
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, groups = TaskContext.get().partitionId() % SALTS, {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *own, doc_id, key_text, value_text, shown in zip(*columns, strict=True):
                name = (*map(repr, own), shown)
                group = groups.get(name)
                if group is None:
                    group = groups[name] = _Group(reducer, own, doc_id, shown)
                group.add(doc_id, key_text, value_text)
            if len(groups) > MOST_GROUPS:
                yield out(groups, salt)
                groups = {}
        if groups:
            yield out(groups, salt)

    def out(groups: dict, salt: int) -> pa.RecordBatch:
        done = [(*g.own, g.first_id, g.shown, g.finish(), g.size, salt) for g in groups.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    @F.pandas_udf("string")
    def again(lists: pd.Series) -> pd.Series:
        return lists.map(lambda parts: _again(reducer, [json.loads(p) for p in parts]))

    parts = each.mapInArrow(partial, schema)
    if "gkey" in by:
        parts = parts.withColumn("gkey", C.json_key(F.col("head")))
    for salted in (True, False):
        found = F.transform(F.sort_array(F.collect_list(F.struct("first_id", "part"))), lambda x: x["part"]).alias("parts")
        grouped = parts.groupBy(*by, *(["salt"] if salted else [])).agg(F.min_by("head", "first_id").alias("head"), F.min("first_id").alias("first_id"), F.sum("size").alias("size"), found)
        parts = grouped.where(F.size("parts") > 0).withColumn("part", F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(again("parts"))).drop("parts")
    grown = (F.length("part") > 200) & (2 * F.length("part") > F.col("size"))
    return parts.select(*by, F.col("head").alias("key_json"), F.when(~grown, F.col("part")).alias("value"), F.when(grown, F.lit("reduce_overflow_error")).alias("error"))


class _Group:
    """The rows of one group in a partition: reduced by chunks, which are rereduced."""

    def __init__(self, reducer: Callable, own: list, doc_id: str, shown: str):
        self.reducer, self.own, self.first_id, self.shown = reducer, own, doc_id, shown
        self.keys, self.values, self.parts, self.size = [], [], [], 0

    def add(self, doc_id: str, key: str, value: str) -> None:
        self.first_id = min(self.first_id, doc_id)
        self.keys.append([json.loads(key), doc_id])
        self.values.append(json.loads(value))
        self.size += len(value)
        if len(self.keys) >= CHUNK:
            self.reduce()

    def reduce(self) -> None:
        self.parts.append(self.reducer(self.keys, self.values, False))
        self.keys, self.values = [], []
        if len(self.parts) >= CHUNK:
            self.parts = [self.reducer(None, self.parts, True)]

    def finish(self) -> str:
        if self.keys:
            self.reduce()
        return json.dumps(self.parts[0] if len(self.parts) == 1 else self.reducer(None, self.parts, True))


def _again(reducer: Callable, parts: list) -> str:
    while len(parts) > 1:
        parts = [reducer(None, parts[i : i + CHUNK], True) for i in range(0, len(parts), CHUNK)]
    return json.dumps(parts[0])


def levels(index: Index, deepest: int) -> DataFrame:
    """Counts and sums at every group level at once, by ROLLUP (declared array keys with number values)."""
    names = index.part_names()[:deepest]
    out = index.rows.rollup(*names).agg(F.grouping_id().alias("__g"), F.count("*").alias("count"), F.sum(F.col("value").cast("double")).alias("sum"))
    depth = F.lit(deepest) - F.length(F.regexp_replace(F.bin(F.col("__g")), "0", ""))
    return out.withColumn("level", depth.cast("int")).drop("__g")
