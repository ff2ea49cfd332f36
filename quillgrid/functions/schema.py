"""Schemas written as text, without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def struct(text: str) -> T.StructType:
    """``name kind, name kind`` of plain kinds as a StructType."""
    pairs = [x.split() for x in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])
