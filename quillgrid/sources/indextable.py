"""Stored index rows: a base in key order and deltas after it, brought up to date by document.

A part holds rows (id, key, ...) and, as rows that are ``gone``, the ids that it was made for. A row counts unless a later
part was made for its id. Updates thus write what changed only; after ``MOST`` deltas the rows that count become a new
base. Bases are dealt by ranges of the key and sorted, and their plain columns k_rank (the key's type), e_rank (the type of
an array's first element) and number (the key's or that element's) reach the Parquet scan, so that a range reads the files
and row groups that it needs. Folder names hold the sequence and purge numbers that a part has reached.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import collation as C
from quillgrid.session import apart
from quillgrid.sources.folder import Folder

MOST = 8
PLAIN_KEY = "array<struct<r:int,n:double,s:string>>"


def lead_columns(key: Column) -> list[Column]:
    """k_rank, e_rank and number of a key."""
    first = F.when(key[0]["r"] == C.ARRAY, F.try_element_at(key, F.lit(2)))
    return [key[0]["r"].alias("k_rank"), first["r"].alias("e_rank"), F.coalesce(key[0]["n"], first["n"]).alias("number")]


def lead_test(value: Any, low: bool) -> Column:
    """What the plain columns of a key must satisfy if it isn't before (low) or after the key ``value``."""
    rank, kind = C.rank_of(value), F.col("k_rank")
    inside = F.lit(True)
    if rank == C.NUMBER:
        inside = _beyond(F.col("number"), float(value), low)
    elif rank == C.ARRAY and len(value):
        inner, element = C.rank_of(value[0]), F.col("e_rank")
        same = _beyond(F.col("number"), float(value[0]), low) if inner == C.NUMBER else F.lit(True)
        empty = F.lit(False) if low else element == C.CLOSE
        inside = (element > inner if low else element < inner) | empty | ((element == inner) & same)
    return (kind > rank if low else kind < rank) | ((kind == rank) & inside)


def _beyond(column: Column, bound: float, low: bool) -> Column:
    return column >= F.lit(bound) if low else column <= F.lit(bound)


class IndexTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def reached(self) -> tuple[int, int]:
        """The sequence and purge numbers that the rows are up to."""
        parts = self.folder.parts()
        return (parts[-1]["seq"], parts[-1]["purge"]) if parts else (0, 0)

    def active_size(self) -> int:
        """Bytes of the parts that are read."""
        return sum(self.folder.at(p["path"]).size() for p in self._live())

    def _live(self) -> list[dict[str, int]]:
        parts = self.folder.parts()
        return parts[max((i for i, p in enumerate(parts) if p["whole"]), default=0) :]

    def read(self) -> DataFrame | None:
        """The rows that count, their key in key order; None before the first update."""
        live = self._live()
        if not live:
            return None
        rows, newer = None, None
        for p in reversed(live):
            part = self.spark.read.parquet(f"{self.folder.path}/{p['path']}")
            own = part.where("not gone").drop("gone")
            own = own if newer is None else own.join(newer, "id", "left_anti")
            rows = own if rows is None else rows.unionByName(own)
            ids = part.where("gone").select("id")
            newer = ids if newer is None else newer.union(ids)
        return rows.withColumn("key", F.col("key").cast(C.KEY))

    def update(self, changed: DataFrame | None, rows: DataFrame, seq: int, purge: int = 0) -> None:
        """Take the rows of ``changed`` (ids) for what these documents have now; all there are if it is None."""
        parts, live = self.folder.parts(), self._live()
        n = parts[-1]["n"] + 1 if parts else 1
        if changed is None or not live:
            self._write(rows, n, seq, purge, None)
        else:
            self._write(rows, n, seq, purge, changed)
            if len(live) >= MOST:
                self._write(self.read(), n + 1, seq, purge, None)
        for p in self.folder.parts()[: -2 * MOST]:
            if p["n"] < self._live()[0]["n"]:
                self.folder.at(p["path"]).delete()

    def _write(self, rows: DataFrame, n: int, seq: int, purge: int, changed: DataFrame | None) -> None:
        if changed is None:  # written before it is sorted: finding ranges would run the map a second time
            staged = Folder(self.spark, f"{self.folder.path}-staged")
            rows.withColumn("key", F.col("key").cast(PLAIN_KEY)).write.mode("overwrite").parquet(staged.path)
            rows = self.spark.read.parquet(staged.path).withColumn("key", F.col("key").cast(C.KEY))
        keyed = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id") if changed is None else rows
        if "k_rank" not in keyed.columns:
            keyed = keyed.select("*", *lead_columns(F.col("key")))
        out = keyed.withColumn("key", F.col("key").cast(PLAIN_KEY)).withColumn("gone", F.lit(False))
        if changed is not None:
            ids = changed.select("id").distinct()
            marks = ids.select(*[F.lit(True).alias("gone") if f.name == "gone" else F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields])
            out = out.unionByName(apart(marks))
        self.folder.write(out, n=n, whole=int(changed is None), seq=seq, purge=purge)
        if changed is None:
            staged.delete()


def prefix_bounds(fields: tuple[str, ...], found: dict[str, Any]) -> tuple[list, list, bool]:
    """(low values, high values, bounded): the index key's beginning that the ranges of a selector leave.

    Equal fields first, then the range of the next one; what these keys exclude the selector excludes too.
    """
    low, high = [], []
    for name in fields:
        r = found.get(name)
        if r is None:
            break
        if r.has_eq:
            low.append(r.eq)
            high.append(r.eq)
            continue
        low += [r.low[0]] if r.low else []
        high += [r.high[0]] if r.high else []
        break
    return low, high, bool(low or high)


def between(low: list, high: list) -> Column:
    """Keys (arrays) that begin with values from low to high."""
    test = F.lit(True)
    if low:
        tokens = [(C.ARRAY, None, None), *(t for v in low for t in C.tokens(v, True))]
        test = test & lead_test([low[0]], True) & (F.col("key") >= C.tokens_literal(tokens))
    if high:
        tokens = [(C.ARRAY, None, None), *(t for v in high for t in C.tokens(v, True)), (C.OBJECT + 1, None, None)]
        test = test & lead_test([high[0]], False) & (F.col("key") <= C.tokens_literal(tokens))
    return test


def json_array(parts: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
