"""Selectors as Columns: every node becomes a boolean that is never null.

Two document modes share one compiler. In *typed* mode fields are columns (dots reach into structs) whose JSON type
is known from the schema, so comparisons are plain predicates that reach the Parquet scan, and SQL NULL is a missing
field. In *variant* mode fields are paths into a VARIANT body; its extraction coerces between types, so the value's
rank is taken first and the comparison made inside that rank.
"""

from __future__ import annotations

import json
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import SelectorError
from quillgrid.functions import collation as C
from quillgrid.plans.selector import Cond, Doc, Field, parse


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Typed:
    """A column of a known Spark type."""

    def __init__(self, col: Column, kind: T.DataType):
        self.col, self.kind = col, kind
        self.fixed = C.NUMBER if isinstance(kind, T.NumericType) else C.ARRAY if isinstance(kind, T.ArrayType) else C.OBJECT if isinstance(kind, (T.StructType, T.MapType)) else None if isinstance(kind, T.BooleanType) else C.STRING

    def present(self) -> Column:
        return self.col.isNotNull()

    def rank(self) -> Column:
        return F.when(self.col, C.TRUE).otherwise(C.FALSE) if self.fixed is None else F.lit(self.fixed)

    def string(self, collated: bool = False) -> Column:
        text = self.col if isinstance(self.kind, T.StringType) else F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)) else self.col.cast("string")
        return F.collate(text, "UNICODE") if collated else text

    def number(self) -> Column:
        return self.col

    def has_rank(self, *ranks: int) -> Column:
        if self.fixed is None:
            return F.lit(True) if {1, 2} <= set(ranks) else self.col if C.TRUE in ranks else ~self.col if C.FALSE in ranks else F.lit(False)
        return F.lit(self.fixed in ranks)

    def member(self, name: str) -> Typed | None:
        if isinstance(self.kind, T.StructType) and name in self.kind.names:
            return Typed(self.col.getField(name), self.kind[name].dataType)
        if isinstance(self.kind, T.MapType):
            return Typed(F.try_element_at(self.col, F.lit(name)), self.kind.valueType)
        return None

    def elements(self) -> tuple[Column, Any] | None:
        return (self.col, lambda e: Typed(e, self.kind.elementType)) if self.fixed == C.ARRAY else None

    def names(self) -> Column | None:
        if isinstance(self.kind, T.StructType):
            return F.array(*[F.when(self.col.getField(n).isNotNull(), F.lit(n)) for n in self.kind.names])
        return F.map_keys(self.col) if isinstance(self.kind, T.MapType) else None

    def is_whole(self) -> Column:
        return F.lit(isinstance(self.kind, T.IntegralType))

    def json(self) -> Column:
        return F.to_json(self.col) if self.fixed in (C.ARRAY, C.OBJECT) else F.to_json(F.struct(self.col))

    def key(self) -> Column:
        flat = not isinstance(self.kind, (T.StructType, T.MapType)) and not (isinstance(self.kind, T.ArrayType) and isinstance(self.kind.elementType, (T.ArrayType, T.StructType, T.MapType)))
        return C.typed_key(self.col, self.kind) if flat else C.json_key(F.to_json(self.col), True)


class Variant:
    """A VARIANT value; null means missing."""

    def __init__(self, col: Column):
        self.col = col
        self.shape = F.schema_of_variant(col)

    def present(self) -> Column:
        return self.col.isNotNull()

    def rank(self) -> Column:
        shape = self.shape
        truth = F.when(F.try_variant_get(self.col, "$", "boolean"), C.TRUE).otherwise(C.FALSE)
        return F.when(shape == "VOID", C.NULL).when(shape == "BOOLEAN", truth).when(shape == "STRING", C.STRING).when(shape.startswith("ARRAY"), C.ARRAY).when(shape.startswith("OBJECT"), C.OBJECT).otherwise(C.NUMBER)

    def string(self, collated: bool = False) -> Column:
        text = F.try_variant_get(self.col, "$", "string")
        return F.collate(text, "UNICODE") if collated else text

    def number(self) -> Column:
        return F.try_variant_get(self.col, "$", "double")

    def has_rank(self, *ranks: int) -> Column:
        return self.rank().isin(*ranks)

    def member(self, name: str) -> Variant:
        return Variant(F.try_variant_get(self.col, "$[" + json.dumps(name, ensure_ascii=False) + "]", "variant"))

    def elements(self) -> tuple[Column, Any]:
        return F.when(self.has_rank(C.ARRAY), F.try_variant_get(self.col, "$", "array<variant>")), Variant

    def names(self) -> Column:
        return F.when(self.has_rank(C.OBJECT), F.json_object_keys(F.to_json(self.col)))

    def is_whole(self) -> Column:
        return self.shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (self.shape.startswith("DECIMAL") & (self.number() == F.floor(self.number())))

    def json(self) -> Column:
        return F.to_json(self.col)

    def key(self) -> Column:
        return C.json_key(F.to_json(self.col), True)


class Row:
    """A row of a typed DataFrame as a document."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def member(self, name: str) -> Typed | None:
        return Typed(F.col(f"`{name}`"), self.schema[name].dataType) if name in self.schema.names else None


def field_of(doc: Any, path: tuple[str, ...]) -> Any:
    """The value at a path, or None where the schema says it is always missing."""
    if isinstance(doc, Row) and ".".join(path) in doc.schema.names:
        return doc.member(".".join(path))
    value = doc
    for name in path:
        value = value.member(name) if value is not None else None
    return value


def compile_selector(selector: dict | Doc, doc: Any) -> Column:
    """The Column of a selector over ``doc``: a Row, or a Variant body."""
    return _document(parse(selector) if isinstance(selector, dict) else selector, doc)


def _document(node: Doc | Field, doc: Any) -> Column:
    if isinstance(node, Field):
        value = field_of(doc, node.path)
        if node.cond.op == "$exists":
            there = value.present() if value is not None else F.lit(False)
            return there if node.cond.arg else ~there
        if value is None:
            return F.lit(False)
        test = value.present() & _value(node.cond, value)
        return test if isinstance(value, Typed) else _sure(test)  # typed conditions are null only where the value is
    each = [_document(x, doc) for x in node.items]
    if node.op == "and":
        return _all(each)
    return _any(each) if node.op == "or" else ~_any(each)


def _value(cond: Cond, v: Any) -> Column:
    """A condition on a value that is there; null at most where a typed value is null."""
    op, arg = cond.op, cond.arg
    if op in ("$eq", "$ne", "$lt", "$lte", "$gt", "$gte"):
        return _compare(op, arg, v)
    if op == "$exists":
        return F.lit(bool(arg))
    if op in ("$in", "$nin"):
        found = _any([_equal(x, v) for x in arg])
        if (inner := v.elements()) is not None and arg:
            found = found | _sure(F.exists(inner[0], lambda e: _sure(_any([_equal(x, inner[1](e)) for x in arg]))))
        return found if op == "$in" else ~found
    if op == "$type":
        return _sure(v.has_rank(*C.TYPE_NAMES[arg])) if arg in C.TYPE_NAMES else F.lit(False)
    if op == "$regex":
        return _sure(v.has_rank(C.STRING) & v.string().rlike(arg)) if not _never(v, C.STRING) else F.lit(False)
    if op == "$mod":
        if _never(v, C.NUMBER):
            return F.lit(False)
        divisor, rest = arg
        return _sure(v.has_rank(C.NUMBER) & v.is_whole() & (v.number().cast("bigint") % F.lit(divisor) == F.lit(rest)))
    if op in ("$and", "$or", "$nor"):
        each = [_value(c, v) if c.op != "$exists" else F.lit(bool(c.arg)) for c in arg]
        return _all(each) if op == "$and" else _any(each) if op == "$or" else ~_any(each)
    if op == "$not":
        return ~_value(arg, v)
    if op == "$keyMapMatch":
        names = v.names()
        return _sure(F.exists(names, lambda n: _sure(_value(arg, Typed(n, T.StringType()))))) if names is not None else F.lit(False)
    inner = v.elements()
    if inner is None:
        return F.lit(False)
    array, wrap = inner
    if op == "$size":
        return _sure(F.size(array) == arg)
    if op == "$all":
        return _sure(array.isNotNull() & _all([F.exists(array, partial(_is, wrap, x)) for x in arg]))
    if op in ("$elemMatch", "$allMatch"):
        test = (lambda e: _sure(_value(arg, wrap(e)) & wrap(e).present())) if isinstance(arg, Cond) else (lambda e: _document(arg, wrap(e)))
        return _sure(F.exists(array, test) if op == "$elemMatch" else F.forall(array, test))
    raise SelectorError("invalid_operator", f"Invalid operator: {op}")


def _is(wrap: Any, item: Any, element: Column) -> Column:
    return _sure(_equal(item, wrap(element)))


def _never(v: Any, rank: int) -> bool:
    return isinstance(v, Typed) and v.fixed != rank


def _equal(arg: Any, v: Any) -> Column:
    rank = C.rank_of(arg)
    if isinstance(v, Typed) and v.fixed is not None and v.fixed != rank:
        return F.lit(False)
    if rank in (C.NULL, C.FALSE, C.TRUE):
        return _sure(v.has_rank(rank))
    if rank == C.NUMBER:
        return v.number() == F.lit(arg) if isinstance(v, Typed) else _sure(v.has_rank(rank) & (v.number() == F.lit(float(arg))))
    if rank == C.STRING:
        return v.string() == F.lit(arg) if isinstance(v, Typed) else _sure(v.has_rank(rank) & (v.string(True) == F.lit(arg)))
    # variants sort members and write numbers in one way, so equal values have equal text
    there = F.to_json(F.try_parse_json(v.json()))
    return _sure(v.has_rank(rank) & (there == F.to_json(F.parse_json(F.lit(json.dumps(arg))))))


def _compare(op: str, arg: Any, v: Any) -> Column:
    if op == "$eq":
        return _equal(arg, v)
    if op == "$ne":
        return ~_equal(arg, v)
    rank = C.rank_of(arg)
    up = op in ("$gt", "$gte")
    if isinstance(v, Typed) and v.fixed is not None and v.fixed != rank:
        return F.lit((v.fixed > rank) == up)
    beyond = v.rank() > rank if up else v.rank() < rank
    if rank in (C.NULL, C.FALSE, C.TRUE):
        return _sure(beyond | (v.has_rank(rank) if op in ("$gte", "$lte") else F.lit(False)))
    if rank in (C.ARRAY, C.OBJECT):
        return _sure(beyond | (v.has_rank(rank) & _ordered(op, v.key(), C.key_literal(arg, True))))
    there, x = (v.number(), F.lit(arg if isinstance(v, Typed) else float(arg))) if rank == C.NUMBER else (v.string(True), F.lit(arg))
    test = _ordered(op, there, x)
    return test if isinstance(v, Typed) else _sure(beyond | (v.has_rank(rank) & test))


def _ordered(op: str, a: Column, b: Column) -> Column:
    return a > b if op == "$gt" else a >= b if op == "$gte" else a < b if op == "$lt" else a <= b


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """Typed mode: the listed paths, nested ones rebuilt as structs; paths that the schema lacks are left out."""
    tree: dict = {}
    for path in fields:
        steps = [path] if path in df.columns else path.split(".")
        if field_of(Row(df), tuple(steps)) is None:
            continue
        at = tree
        for name in steps[:-1]:
            at = at.setdefault(name, {})
            if at is None:
                break
        if at is not None:
            at[steps[-1]] = None

    def build(at: dict, value: Any) -> list[Column]:
        return [(value.member(n).col if inner is None else F.struct(*build(inner, value.member(n)))).alias(n) for n, inner in at.items()]

    return df.select(*build(tree, Row(df)))


def project_json(body: Column, fields: list[str]) -> Column:
    """Variant mode: JSON text with the listed paths of a JSON text, nesting rebuilt, missing ones left out."""
    return _project_json(body, F.lit(json.dumps([f.split(".") for f in fields])))


@F.pandas_udf(T.StringType())
def _project_json(bodies, paths):  # noqa: ANN001, ANN202
    wanted = json.loads(paths.iloc[0]) if len(paths) else []
    return bodies.map(lambda x: json.dumps(project_value(json.loads(x), wanted), ensure_ascii=False, separators=(",", ":")), na_action="ignore")


def project_value(doc: dict, paths: list[list[str]]) -> dict:
    out: dict = {}
    for path in paths:
        value: Any = doc
        for name in path:
            value = value.get(name, ...) if isinstance(value, dict) else ...
            if value is ...:
                break
        else:
            at = out
            for name in path[:-1]:
                at = at.setdefault(name, {})
            at[path[-1]] = value
    return out
