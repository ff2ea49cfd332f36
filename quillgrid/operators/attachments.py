"""Attachments: a revision holds their stubs as JSON text, a table keyed by digest holds their bytes.

A stub says content type, digest, length and the generation that the attachment came with. Bytes are stored once for each
digest, so a revision that keeps an attachment, a copy and a replica move stubs only. Compressible types are stored as
gzip; the digest is that of the stored bytes.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import QueryError

BLOBS = "digest string, encoding string, data binary"
STUB = "map<string,struct<content_type:string,revpos:int,digest:string,length:bigint,stub:boolean>>"
#: Content types that are stored compressed.
COMPRESSIBLE = ("text/", "application/javascript", "application/json", "application/xml")


def digest(data: Column) -> Column:
    """md5- and the base64 of the MD5 of the stored bytes."""
    return F.concat(F.lit("md5-"), F.base64(F.unhex(F.md5(data))))


@F.pandas_udf(T.BinaryType())
def gzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda b: gzip.compress(bytes(b), mtime=0), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def gunzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda b: gzip.decompress(bytes(b)), na_action="ignore")


def compressible(content_type: Column) -> Column:
    test = F.lit(False)
    for prefix in COMPRESSIBLE:
        test = test | content_type.startswith(prefix)
    return test


def put(rows: DataFrame, compress: bool = True) -> DataFrame:
    """Rows (id, num, hash, name, content_type, data) as stored attachments of that generation, with their bytes."""
    squeeze = compressible(F.col("content_type")) if compress else F.lit(False)
    stored = F.coalesce(gzipped(F.when(squeeze, F.col("data"))), "data") if compress else F.col("data")
    return rows.select("id", "num", "hash", "name", "content_type", digest(stored).alias("digest"), F.col("num").alias("revpos"), F.length("data").cast("bigint").alias("length"), F.when(squeeze, F.lit("gzip")).alias("encoding"), stored.alias("data"))


def stubs(stored: DataFrame) -> DataFrame:
    """(id, num, hash, atts): the stubs of each revision's attachments, by name."""
    stub = F.struct("content_type", "revpos", "digest", "length", F.lit(True).alias("stub"))
    each = F.sort_array(F.collect_list(F.struct("name", stub.alias("stub"))))
    return stored.groupBy("id", "num", "hash").agg(F.to_json(F.map_from_entries(each)).alias("atts"))


def written(said: dict[str, Any], parent: str | None, num: int) -> tuple[dict[str, dict], list[dict]]:
    """Stubs of a new revision's attachments and the bytes that come with it.

    A member marked as a stub keeps its parent's; one with data is new; those that aren't named go.
    """
    old, out, blobs = json.loads(parent) if parent else {}, {}, []
    for name, a in said.items():
        if not name or name.startswith("_") or not isinstance(a, dict):
            raise QueryError("bad_request", f"Attachment name '{name}' starts with prohibited character '_'" if name.startswith("_") else "Malformed attachment")
        if a.get("stub"):
            if name not in old:
                raise QueryError("missing_stub", f"Invalid attachment stub for {name}", 412)
            out[name] = old[name]
            continue
        try:
            data = base64.b64decode(a.get("data", ""), validate=True)
        except (binascii.Error, TypeError, ValueError) as bad:
            raise QueryError("bad_request", "Invalid attachment data, must be base64") from bad
        kind = a.get("content_type") or "application/octet-stream"
        squeeze = kind.startswith(COMPRESSIBLE)
        stored = gzip.compress(data, mtime=0) if squeeze else data
        mark = "md5-" + base64.b64encode(hashlib.md5(stored).digest()).decode()
        out[name] = {"content_type": kind, "revpos": num, "digest": mark, "length": len(data), "stub": True}
        blobs.append({"digest": mark, "encoding": "gzip" if squeeze else None, "data": stored})
    return out, blobs


def entries(revs: DataFrame) -> DataFrame:
    """One row for each attachment of each revision: id, num, hash, name, content_type, revpos, digest, length."""
    each = revs.where("atts is not null").select("id", "num", "hash", F.explode(F.from_json("atts", STUB)).alias("name", "a"))
    return each.select("id", "num", "hash", "name", "a.content_type", "a.revpos", "a.digest", "a.length")


def plain(data: str = "data", encoding: str = "encoding") -> Column:
    """The bytes that a client gave."""
    return F.coalesce(gunzipped(F.when(F.col(encoding) == "gzip", F.col(data))), F.col(data))


def get(revs: DataFrame, blobs: DataFrame, doc_id: str, num: int, hash_: str, name: str, start: int = 0, end: int | None = None) -> DataFrame:
    """content_type, digest, length and the plain bytes of an attachment, or an inclusive range of them."""
    own = entries(revs.where((F.col("id") == doc_id) & (F.col("num") == num) & (F.col("hash") == hash_))).where(F.col("name") == name)
    rows = own.join(blobs.dropDuplicates(["digest"]), "digest").select("content_type", "digest", "length", plain().alias("data"))
    size = F.length("data") if end is None else F.lit(end - start + 1)
    return rows.withColumn("data", F.substring("data", F.lit(start + 1), size))


def with_data(rows: DataFrame, blobs: DataFrame, since: int = 0) -> DataFrame:
    """rows (id, num, hash, atts) with the data of attachments newer than generation ``since`` in place of their stubs."""
    each = entries(rows).join(blobs.select("digest", "encoding", "data").dropDuplicates(["digest"]), "digest", "left")
    fresh = F.col("revpos") > since
    said = F.struct("content_type", "revpos", "digest", "length", F.when(~fresh, F.lit(True)).alias("stub"), F.when(fresh, F.translate(F.base64(plain()), "\r\n", "")).alias("data"))
    whole = each.groupBy("id", "num", "hash").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", said.alias("a")))))).alias("__atts"))
    return rows.join(whole, ["id", "num", "hash"], "left").withColumn("atts", F.coalesce("__atts", "atts")).drop("__atts")


def used(blobs: DataFrame, revs: DataFrame) -> DataFrame:
    """The bytes that some revision's stubs name, once for each digest."""
    return blobs.join(entries(revs).select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
