"""One total order over all JSON values, as a sortable and groupable column.

A value becomes an array of tokens (rank, number, string): its rank by type, then what decides inside the type.
Arrays and objects are opened by their rank and closed by rank -1, which sorts before every value, so a prefix comes
first. Strings have the UNICODE collation. Arrays of tokens compare element by element in Spark, so ``orderBy``,
``groupBy``, range filters, ``min`` and ``max`` follow the order of the values without any Python.

Keys of typed columns and flat arrays are built by expressions; JSON text of any depth by a vectorized function.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.schema import struct

CLOSE, NULL, FALSE, TRUE, NUMBER, STRING, ARRAY, OBJECT = -1, 0, 1, 2, 3, 4, 5, 6
TYPE_NAMES = {"null": (NULL,), "boolean": (FALSE, TRUE), "number": (NUMBER,), "string": (STRING,), "array": (ARRAY,), "object": (OBJECT,)}

_PLAIN = T.ArrayType(struct("r int, n double, s string"))
KEY = "array<struct<r:int,n:double,s:string collate UNICODE>>"


def rank_of(value: Any) -> int:
    """Rank of a decoded JSON value."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return TRUE if value else FALSE
    if isinstance(value, (int, float, Decimal)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    return ARRAY if isinstance(value, (list, tuple)) else OBJECT


def tokens(value: Any, sort_members: bool = False) -> list[tuple[int, float | None, str | None]]:
    """Tokens of a decoded JSON value; ``sort_members`` orders object members by name first (selectors do)."""
    rank = rank_of(value)
    if rank == NUMBER:
        number = float(value)
        if number in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        return [(rank, number + 0.0, None)]
    if rank == STRING:
        return [(rank, None, value)]
    if rank == ARRAY:
        return [(rank, None, None), *(t for x in value for t in tokens(x, sort_members)), (CLOSE, None, None)]
    if rank == OBJECT:
        members = sorted(value.items()) if sort_members else value.items()
        return [(rank, None, None), *(t for k, x in members for t in [(STRING, None, k), *tokens(x, sort_members)]), (CLOSE, None, None)]
    return [(rank, None, None)]


def key_literal(value: Any, sort_members: bool = False) -> Column:
    """A constant key."""
    return tokens_literal(tokens(value, sort_members))


def tokens_literal(found: list[tuple[int, float | None, str | None]]) -> Column:
    each = [_token(r, None if n is None else F.lit(n), None if s is None else F.lit(s)) for r, n, s in found]
    return F.array(*each).cast(KEY)


def _token(rank: int | Column, number: Column | None = None, string: Column | None = None) -> Column:
    r = F.lit(rank) if isinstance(rank, int) else rank
    n = F.lit(None) if number is None else number
    s = F.lit(None) if string is None else string
    return F.struct(r.cast("int").alias("r"), n.cast("double").alias("n"), s.cast("string").alias("s"))


def _scalar(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return _token(F.when(c.isNull(), NULL).when(c, TRUE).otherwise(FALSE))
    if isinstance(kind, T.NumericType):
        return _token(F.when(c.isNull(), NULL).otherwise(NUMBER), c.cast("double") + F.lit(0.0))
    if isinstance(kind, T.NullType):
        return _token(NULL)
    return _token(F.when(c.isNull(), NULL).otherwise(STRING), None, c)


def typed_key(c: Column, kind: T.DataType) -> Column:
    """The key of a scalar column or of an array of scalars."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: _scalar(x, kind.elementType))
        whole = F.concat(F.array(_token(ARRAY)), inner, F.array(_token(CLOSE)))
        return F.when(c.isNull(), F.array(_token(NULL))).otherwise(whole).cast(KEY)
    return F.array(_scalar(c, kind)).cast(KEY)


def compound_key(parts: list[tuple[Column, T.DataType]]) -> Column:
    """The key of the array [part, part, ...] of scalar columns."""
    return F.array(_token(ARRAY), *(_scalar(c, kind) for c, kind in parts), _token(CLOSE)).cast(KEY)


@F.pandas_udf(_PLAIN)
def _json_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(_tokens_of, na_action="ignore")


@F.pandas_udf(_PLAIN)
def _json_tokens_sorted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: _tokens_of(x, True), na_action="ignore")


def _tokens_of(text: str, sort_members: bool = False) -> list[dict] | None:
    try:
        return [{"r": r, "n": n, "s": s} for r, n, s in tokens(json.loads(text), sort_members)]
    except (ValueError, OverflowError):
        return None


def json_key(text: Column, sort_members: bool = False) -> Column:
    """The key of JSON text; null for text that isn't JSON or a number beyond double."""
    return (_json_tokens_sorted if sort_members else _json_tokens)(text).cast(KEY)


def compare(a: Any, b: Any, strings: Callable[[str, str], int], sort_members: bool = False) -> int:
    """Order of two decoded values by plain recursion, for tests; ``strings`` orders two strings."""
    ra, rb = rank_of(a), rank_of(b)
    if ra != rb:
        return -1 if ra < rb else 1
    if ra == NUMBER:
        return (float(a) > float(b)) - (float(a) < float(b))
    if ra == STRING:
        return strings(a, b)
    if ra in (ARRAY, OBJECT):
        left, right = ([[x for kv in (sorted(v.items()) if sort_members else v.items()) for x in kv] if ra == OBJECT else list(v)] for v in (a, b))
        for x, y in zip(left[0], right[0], strict=False):
            if order := compare(x, y, strings, sort_members):
                return order
        return (len(left[0]) > len(right[0])) - (len(left[0]) < len(right[0]))
    return 0


def truncate(value: Any, level: int) -> Any:
    """An array key cut to ``level`` elements; other values, and negative levels, as they are."""
    return value[:level] if isinstance(value, list) and level >= 0 else value


def rendered(number: Column) -> Column:
    """A double as JSON text: whole numbers below 1e15 without a fraction."""
    whole = (number == F.rint(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(number.cast("string"))
