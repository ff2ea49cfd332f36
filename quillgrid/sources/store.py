"""A document store on a folder: an append-only log of commits in Parquet, read with Spark, written by one writer.

    log/n=N.seq=U            revisions that commit N appended; U is the last sequence number given out
    base/n=K.upto=N.seq=U.purge=P   all revisions of the commits up to N, after P purges
    purged/n=P               what the purges up to number P removed
    blobs/n=N                bytes of attachments, by digest
    local/n=N                all local documents; n=N.doc=H.rev=R has one that was put since

A folder counts once its job has finished. The names hold the sequence and purge numbers, so they are read without a job
and never depend on the rows that are left: a number is given out once, whatever is purged. Compaction and purges write a
new base and leave the old one to readers that still use it; the log only grows, so streams over it go on. Readers see
what was there when they listed it, which makes every read a snapshot.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.errors import NotFound, QueryError
from quillgrid.functions.revid import parse_rev
from quillgrid.operators import attachments as A
from quillgrid.operators import revisions as R
from quillgrid.operators import scan, write
from quillgrid.operators.changes import Changes, ChangesQuery, changes
from quillgrid.operators.find import Find, Found, find
from quillgrid.sources.folder import Folder
from quillgrid.sources.indexes import StoreIndexes

LOCAL = "id string, n bigint, body string"
#: Local documents that are put one by one before all are written together.
MOST = 100
#: Older states of a local document that stay for those who have listed them.
OLDER = 10


class Snapshot(NamedTuple):
    """What a reader sees: the folders of revisions, and the numbers reached."""

    paths: list[str]
    commit: int
    seq: int
    purge: int


class Store:
    def __init__(self, spark: SparkSession, path: str, partitioned: bool = False, revs_limit: int = R.REVS_LIMIT, partition_limit: int | None = None):
        self.spark, self.folder, self.partitioned = spark, Folder(spark, path), partitioned
        self.revs_limit, self.partition_limit = revs_limit, partition_limit
        self.log, self.base = self.folder.at("log"), self.folder.at("base")
        self.indexes = StoreIndexes(self)

    @staticmethod
    def check_name(name: str) -> str:
        if not re.fullmatch(r"[a-z][a-z0-9_$()+/-]*", name) and not name.startswith("_"):
            raise QueryError("illegal_database_name", name)
        return name

    def snapshot(self, upto: int | None = None) -> Snapshot:
        """The newest state, or that after a commit."""
        commits = [c for c in self.log.parts() if upto is None or c["n"] <= upto]
        bases = [b for b in self.base.parts() if upto is None or b["upto"] <= upto]
        base = bases[-1] if bases else {"upto": 0, "seq": 0, "purge": 0}
        later = [c for c in commits if c["n"] > base["upto"]]
        paths = [f"{self.base.path}/{base['path']}"] if bases else []
        last = commits[-1] if commits else {"n": 0, "seq": 0}
        return Snapshot([*paths, *(f"{self.log.path}/{c['path']}" for c in later)], max(last["n"], base["upto"]), max(last["seq"], base["seq"]), base["purge"])

    def commits(self) -> list[int]:
        return [c["n"] for c in self.log.parts()]

    def revs(self, upto: int | None = None) -> DataFrame:
        """All revisions of the commits up to a number: a snapshot by file list."""
        paths = self.snapshot(upto).paths
        return self.spark.read.schema(R.REVS).parquet(*paths) if paths else self.spark.createDataFrame([], R.REVS)

    def append(self, rows: DataFrame, seq: int) -> int:
        """A commit of rows, the last of which has the sequence number ``seq``."""
        number = self.snapshot().commit + 1
        self.log.write(R.whole(rows), n=number, seq=seq)
        return number

    def touched(self) -> tuple[int, int]:
        """When commits and bases were last written; 0 where the file system doesn't say."""
        return self.log.changed(), self.base.changed()

    def adopt(self, path: str, now: Snapshot, seq: int) -> Snapshot:
        """Make finished files of revisions, in this store's file system, the commit after ``now``: a rename, without a job
        or a listing, so that the thousandth takes no longer than the first."""
        to = self.log.take(path, n=now.commit + 1, seq=seq)
        return Snapshot([*now.paths, to], now.commit + 1, seq, now.purge)

    def rewrite(self, rows: DataFrame, purges: int = 0) -> None:
        """Make rows all that the commits so far hold."""
        now, bases = self.snapshot(), self.base.parts()
        self.base.write(R.whole(rows), n=bases[-1]["n"] + 1 if bases else 1, upto=now.commit, seq=now.seq, purge=now.purge + purges)

    def winners(self, with_body: bool = False) -> DataFrame:
        return R.winners(self.revs(), with_body)

    def last_seq(self) -> int:
        """The last sequence number given out; no job, and never less than before."""
        return self.snapshot().seq

    def purge_seq(self) -> int:
        return self.snapshot().purge

    def purged_since(self, purge: int = 0) -> DataFrame:
        """(id, num, hash, purge) that the purges after a number removed."""
        at, kind = self.folder.at("purged"), "id string, num int, hash string, purge bigint"
        paths = [f"{at.path}/{p['path']}" for p in at.parts() if purge < p["n"] <= self.purge_seq()]
        return self.spark.read.schema(kind).parquet(*paths).where(F.col("purge") > purge) if paths else self.spark.createDataFrame([], kind)

    def blobs(self) -> DataFrame:
        at = self.folder.at("blobs")
        parts = at.parts()
        last = max((i for i, p in enumerate(parts) if p.get("whole")), default=0)
        paths = [f"{at.path}/{p['path']}" for p in parts[last:]]
        return self.spark.read.schema(A.BLOBS).parquet(*paths) if paths else self.spark.createDataFrame([], A.BLOBS)

    def add_blobs(self, rows: DataFrame, whole: bool = False) -> None:
        at = self.folder.at("blobs")
        parts = at.parts()
        at.write(rows.select("digest", "encoding", "data"), n=parts[-1]["n"] + 1 if parts else 1, **({"whole": 1} if whole else {}))

    # writes

    def bulk(self, docs: Iterable[dict] | DataFrame, validate: write.Validator | None = None) -> DataFrame:
        """Outcomes by position; a DataFrame of edits (write.EDITS) for large batches."""
        if not isinstance(docs, DataFrame):
            rows = []
            for i, doc in enumerate(docs):
                key = doc.get("_id") or write.random_id()
                rows.append((i, key, doc.get("_rev"), bool(doc.get("_deleted")), json.dumps({k: v for k, v in doc.items() if k not in ("_id", "_rev", "_deleted")}, ensure_ascii=False)))
            docs = self.spark.createDataFrame(rows, write.EDITS)
        if self.partitioned and not docs.where(~F.col("id").contains(":") & ~F.col("id").startswith("_")).isEmpty():
            raise QueryError("illegal_docid", "Doc id must be of form partition:id")
        staged = self.folder.at("staged")
        write.apply_edits(self.revs(), docs, validate).write.mode("overwrite").parquet(staged.path)
        outcomes = self.spark.read.schema(write.OUTCOMES).parquet(staged.path)
        if self.partitioned and self.partition_limit is not None:
            outcomes = self._within_limit(outcomes)
        seen = outcomes.agg(F.count_if("ok").alias("n"), F.count_if(F.size("blobs") > 0).alias("blobs"), F.max("num").alias("top")).first()
        if seen["blobs"]:
            self.add_blobs(outcomes.where("ok").select(F.explode("blobs").alias("b")).select("b.*"))
        last = self.last_seq()
        self.append(write.new_revisions(outcomes, last), last + seen["n"])
        over = (seen["top"] or 0) - self.revs_limit
        if over > 0 and over % max(1, self.revs_limit // 10) == 0:
            self.rewrite(R.prune_history(self.revs(), self.revs_limit))
        return outcomes.select("pos", "id", "ok", "rev", "error", "reason").orderBy("pos")

    def _within_limit(self, outcomes: DataFrame) -> DataFrame:
        """Outcomes less those that grow a partition that is over its limit."""
        size = F.length(F.coalesce("body", F.lit("")))
        stored = self.winners(True).where("not deleted").select("id", size.alias("held"))
        sizes = stored.where(F.col("id").contains(":")).groupBy(F.substring_index("id", ":", 1).alias("part")).agg(F.sum("held").alias("size"))
        grown = outcomes.where("ok").join(stored, "id", "left").select("pos", "id", (F.when(F.col("deleted"), 0).otherwise(size) - F.coalesce("held", F.lit(0))).cast("bigint").alias("growth"))
        bad = write.limit_partitions(grown, sizes, self.partition_limit).where("not accepted").select("pos", F.lit(True).alias("over"))
        met = outcomes.join(bad, "pos", "left").withColumn("ok", F.col("ok") & F.col("over").isNull())
        none = lambda c, said: F.when(F.col("over"), F.lit(said)).otherwise(F.col(c)).alias(c)
        return met.select(*[none(c, {"error": "forbidden", "reason": "Partition is too large", "rev": None}[c]) if c in ("error", "reason", "rev") else c for c in outcomes.columns])

    def put(self, doc: dict, validate: write.Validator | None = None) -> str:
        r = self.bulk([doc], validate).first()
        if not r["ok"]:
            raise QueryError(r["error"], r["reason"], {"conflict": 409, "not_found": 404, "forbidden": 403, "unauthorized": 401, "missing_stub": 412}.get(r["error"], 400))
        return r["rev"]

    def delete(self, doc_id: str, rev: str) -> str:
        return self.put({"_id": doc_id, "_rev": rev, "_deleted": True})

    def copy(self, doc_id: str, to: str, rev: str | None = None) -> str:
        """A document under another id, with its attachments."""
        doc = self.get(doc_id, attachments=True)
        return self.put({**doc, "_id": to, "_rev": rev})

    def put_attachment(self, doc_id: str, name: str, data: bytes, content_type: str = "application/octet-stream", rev: str | None = None) -> str:
        """A new revision of the document (or its first) with one attachment more, or replaced."""
        doc = self.get(doc_id) if rev is not None else {"_id": doc_id}
        files = doc.get("_attachments", {}) | {name: {"content_type": content_type, "data": base64.b64encode(data).decode()}}
        return self.put({**doc, "_rev": rev, "_attachments": files})

    def delete_attachment(self, doc_id: str, name: str, rev: str) -> str:
        doc = self.get(doc_id)
        if name not in doc.get("_attachments", {}):
            raise NotFound("Document is missing attachment")
        return self.put({**doc, "_rev": rev, "_attachments": {k: v for k, v in doc["_attachments"].items() if k != name}})

    def attachment(self, doc_id: str, name: str, rev: str | None = None, start: int = 0, end: int | None = None) -> tuple[str, bytes]:
        """(content type, bytes) of an attachment, or an inclusive range of them."""
        num, hash_ = parse_rev(rev or self.get(doc_id)["_rev"])
        r = A.get(self.revs(), self.blobs(), doc_id, num, hash_, name, start, end).first()
        if r is None:
            raise NotFound("Document is missing attachment")
        return r["content_type"], bytes(r["data"])

    def force(self, docs: DataFrame | list[dict], blobs: DataFrame | None = None) -> None:
        """new_edits=false: documents with their revision path (id, path, deleted, body and, if they have any, atts).

        ``blobs`` has the bytes that the stubs name; those that are stored already are not stored again.
        """
        if isinstance(docs, list):
            rows, data = [], []
            for d in docs:
                start, ids = d["_revisions"]["start"], d["_revisions"]["ids"]
                atts, new = A.written(d.get("_attachments") or {}, None, start)
                for name, a in atts.items():
                    a["revpos"] = d["_attachments"][name].get("revpos", start)
                data += [(b["digest"], b["encoding"], bytearray(b["data"])) for b in new]
                rows.append((d["_id"], [(start - i, h) for i, h in enumerate(ids)], bool(d.get("_deleted")), json.dumps({k: v for k, v in d.items() if not k.startswith("_")}, ensure_ascii=False), json.dumps(atts) if atts else None))
            docs = self.spark.createDataFrame(rows, "id string, path array<struct<num:int,hash:string>>, deleted boolean, body string, atts string")
            blobs = self.spark.createDataFrame(data, A.BLOBS) if data else None
        if blobs is not None:
            self.add_blobs(blobs.dropDuplicates(["digest"]).join(self.blobs().select("digest"), "digest", "left_anti"))
        old, last = self.revs(), self.last_seq()
        numbered = docs.join(write.numbered_ids(docs, last), "id")
        self.append(R.new_by_path(old, numbered), last + docs.select("id").distinct().count())

    def compact(self, limit: int | None = None) -> None:
        """Bodies of inner revisions and what lies too deep go, as do bytes that no attachment names any more."""
        self.rewrite(R.stem(self.revs(), limit or self.revs_limit))
        if self.folder.at("blobs").parts():
            self.add_blobs(A.used(self.blobs(), self.revs()), whole=True)

    def purge(self, requests: dict[str, list[str]] | DataFrame) -> DataFrame:
        """Remove leaves and what only they have, without a trace in the feed; (id, num, hash, purge) of what went.

        Every document that lost something counts one purge. Sequence numbers stay as they are.
        """
        if not isinstance(requests, DataFrame):
            rows = [(i, *parse_rev(r)) for i, revs in requests.items() for r in revs]
            requests = self.spark.createDataFrame(rows, "id string, num int, hash string")
        staged, before, revs = self.folder.at("staged-purge"), self.purge_seq(), self.revs()
        R.purged(revs, requests).write.mode("overwrite").parquet(staged.path)
        gone = self.spark.read.schema("id string, num int, hash string").parquet(staged.path)
        n = gone.select("id").distinct().count()
        if n:
            numbers = write.numbered_ids(gone, before).withColumnRenamed("seq", "purge")
            self.folder.at("purged").write(gone.join(numbers, "id").select("id", "num", "hash", "purge"), n=before + n)
            self.rewrite(revs.join(gone, ["id", "num", "hash"], "left_anti"), n)
        return self.purged_since(before)

    def vacuum(self) -> None:
        """Delete what the newest base has taken over: older bases and the commits in it. Streams begin after it."""
        bases = self.base.parts()
        for b in bases[:-1]:
            self.base.at(b["path"]).delete()
        for c in self.log.parts():
            if bases and c["n"] <= bases[-1]["upto"]:
                self.log.at(c["path"]).delete()

    # reads

    def get(self, doc_id: str, rev: tuple[int, str] | str | None = None, attachments: bool = False, conflicts: bool = False) -> dict:
        """A document with its id, revision and attachments: stubs, or their data."""
        revs = self.revs().where(F.col("id") == doc_id)
        found = scan.get(R.winners(revs), revs, doc_id, parse_rev(rev) if isinstance(rev, str) else rev)
        if attachments:
            found = A.with_data(found, self.blobs())
        r = found.first()
        if r is None or (r["deleted"] and rev is None):
            raise NotFound("deleted" if r else "missing")
        doc = {"_id": doc_id, "_rev": r["rev"], **json.loads(r["body"] or "{}")}
        if r["deleted"]:
            doc["_deleted"] = True
        if r["atts"]:
            doc["_attachments"] = json.loads(r["atts"])
        if conflicts and (c := R.conflicts(revs).first()):
            doc["_conflicts"] = c["conflicts"]
        return doc

    def all_docs(self, **query: Any) -> scan.Page:
        return scan.all_docs(self.winners(), revs=self.revs(), **query)

    def bulk_get(self, wanted: DataFrame, revisions: bool = False, attachments: bool = False) -> DataFrame:
        """(pos, id, rev, body, atts, deleted, error) for wanted (pos, id, num, hash), with ancestry or data if asked for."""
        revs = self.revs()
        found = scan.bulk_get(R.winners(revs), revs, wanted, revisions)
        return A.with_data(found, self.blobs()) if attachments else found

    def changes(self, query: ChangesQuery | None = None) -> Changes:
        """Bodies are read only if the filter looks into documents."""
        looks = query is not None and (callable(query.filter) or query.filter in ("_selector", "_view"))
        revs = self.revs()
        return changes(R.winners(revs, looks), query, revs, self.last_seq(), self.blobs() if query is not None and query.attachments else None)

    def find(self, request: Find | dict) -> Found:
        """Documents that match, read from an index that fits the selector, or from all of them."""
        request = request if isinstance(request, Find) else Find(**request)
        conflicts = R.conflicts(self.revs()) if request.conflicts else None
        return find(self.live(), request, body="body", conflicts=conflicts, catalog=self.indexes)

    def live(self) -> DataFrame:
        docs = self.winners(True).where(~F.col("deleted") & ~F.col("id").startswith("_design/"))
        return docs.select(F.col("id").alias("_id"), "num", "hash", "body", "seq")

    def info(self) -> dict:
        """Counts, numbers reached and sizes: of the live bodies, and of the files."""
        size = F.length(F.coalesce("body", F.lit("")))
        now = self.snapshot()
        row = scan.dbs_info(self.winners(True).withColumn("db", F.lit(self.folder.path.rsplit("/", 1)[-1])), size=size).first()
        said = row.asDict() if row else {"db": self.folder.path.rsplit("/", 1)[-1], "doc_count": 0, "doc_del_count": 0, "external_size": 0}
        return said | {"update_seq": now.seq, "purge_seq": now.purge, "file_size": self.log.size() + self.base.size()}

    # local documents

    def local(self) -> DataFrame:
        at = self.folder.at("local")
        whole, later = _since_whole(at.parts())
        held = self.spark.read.schema(LOCAL).parquet(f"{at.path}/{whole[-1]['path']}") if whole else self.spark.createDataFrame([], LOCAL)
        if not later:
            return held
        new = self.spark.read.schema(LOCAL).json([f"{at.path}/{p['path']}" for p in later])
        return held.unionByName(new).groupBy("id").agg(F.max(F.struct("n", "body")).alias("last")).select("id", "last.n", "last.body")

    def put_local(self, doc_id: str, body: dict) -> None:
        """One small file; a job only where MOST of them are put together, or the document's number is not in a name."""
        at, text = self.folder.at("local"), json.dumps(body)
        found = at.parts()
        number, (whole, later) = (found[-1]["n"] if found else 0) + 1, _since_whole(found)
        if len(later) >= MOST:
            at.write(write.upsert_local(self.local(), self.spark.createDataFrame([(doc_id, text)], "id string, body string")), n=number)
            for p in whole[:-1]:  # who listed them has had time to read
                at.at(p["path"]).delete()
            return
        key = int(hashlib.sha256(doc_id.encode()).hexdigest()[:32], 16)
        same = [p for p in later if p["doc"] == key]
        known = [p["rev"] for p in same]
        if not known and whole:
            known = [r["n"] for r in self.local().where(F.col("id") == doc_id).collect()]
        rev = (known[-1] if known else 0) + 1
        at.put(json.dumps({"id": doc_id, "n": rev, "body": text}), "part.json", n=number, doc=key, rev=rev)
        for p in same[:-OLDER]:
            at.at(p["path"]).delete()

    def get_local(self, doc_id: str) -> dict | None:
        r = self.local().where(F.col("id") == doc_id).first()
        return json.loads(r["body"]) if r else None


def _since_whole(parts: list[dict]) -> tuple[list[dict], list[dict]]:
    """Parts up to the newest that has all local documents, and those of one document after it."""
    n = max((i for i, p in enumerate(parts, 1) if "doc" not in p), default=0)
    return parts[:n], parts[n:]


class Server:
    """Databases below one folder, with a log of their creation and deletion."""

    EVENTS = "event_seq bigint, db string, type string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def create(self, name: str, partitioned: bool = False) -> Store:
        Store.check_name(name)
        store = self.open(name, partitioned)
        if name in self._names():
            raise QueryError("file_exists", "The database could not be created, the file already exists.", 412)
        store.append(self.spark.createDataFrame([], R.REVS), 0)
        self._event(name, "created")
        return store

    def open(self, name: str, partitioned: bool = False) -> Store:
        return Store(self.spark, f"{self.folder.path}/db/{name}", partitioned)

    def drop(self, name: str) -> None:
        if name not in self._names():
            raise NotFound("Database does not exist.")
        self.folder.at(f"db/{name}").delete()
        self._event(name, "deleted")

    def _names(self) -> list[str]:
        return self.folder.at("db").names()

    def databases(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self._names()], "name string")

    def all_dbs(self, **query: Any) -> DataFrame:
        return scan.all_dbs(self.databases(), **query)

    def events(self, since: int = 0) -> DataFrame:
        at = self.folder.at("events")
        rows = self.spark.read.schema(self.EVENTS).parquet(at.path) if at.exists() else self.spark.createDataFrame([], self.EVENTS)
        return scan.db_events(rows, since)

    def _event(self, name: str, kind: str) -> None:
        last = self.events().agg(F.coalesce(F.max("event_seq"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(last + 1, name, kind)], self.EVENTS).write.mode("append").parquet(self.folder.at("events").path)
