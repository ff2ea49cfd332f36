"""Replication between two stores: changes since the checkpoint, minus what the target has, with their history.

What a run copies is worked out once, by joins between the stores' tables, and staged batch by batch as the target's
commits. A batch is then a rename, without a job; a checkpoint document on both sides after each makes the next run, or the
rest of one that failed, incremental.
What is committed meanwhile is copied next. Attachments travel as stubs, with those bytes that the target lacks. A continuous replication is a stream over the source's log.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.errors import QueryError
from quillgrid.operators import attachments as A
from quillgrid.operators import revisions as R
from quillgrid.operators.changes import ChangesQuery, changes
from quillgrid.operators.write import Validator, places
from quillgrid.sources.folder import Folder
from quillgrid.sources.store import Snapshot, Store
from quillgrid.streaming.feeds import continuous, log_stream


@dataclass
class Options:
    doc_ids: list[str] | None = None
    selector: dict | None = None
    filter: Any = None
    query_params: dict = field(default_factory=dict)
    continuous: bool = False


@dataclass
class Stats:
    docs_read: int = 0
    docs_written: int = 0
    doc_write_failures: int = 0
    missing_checked: int = 0
    missing_found: int = 0


def checkpoint_id(source: str, target: str, options: Options) -> str:
    said = asdict(options) | {"filter": str(options.filter), "source": source, "target": target, "continuous": None}
    return "_local/" + hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()[:32]


def since_of(source: Store, target: Store, name: str) -> int:
    marks = [s.get_local(name) for s in (source, target)]
    return marks[0]["seq"] if marks[0] and marks[1] and marks[0] == marks[1] else 0


def replicate(source: Store, target: Store, options: Options | None = None, batch: int = 100_000, validate: Validator | None = None) -> tuple[Stats, int]:
    """One run, until nothing is pending; (what it did, the sequence number reached).

    ``validate`` is what the target's design documents say of new documents: those that it refuses are not written, and
    counted as failures.
    """
    options, stats = options or Options(), Stats()
    name = checkpoint_id(source.folder.path, target.folder.path, options)
    reached = since_of(source, target, name)
    while (run := _pending(source, target, options, reached, batch, validate)) is not None:
        now, touched = run.now, None
        for part in run.batches:
            if part.written:
                if (touched is None or not touched[0] or target.touched() != touched) and target.snapshot() != now:
                    break  # written by others meanwhile: what it lacks and its numbers are worked out again
                now = target.adopt(part.path, now, part.seq)
                touched = target.touched()
            reached = part.upto
            stats.missing_checked += part.checked
            stats.missing_found += part.missing
            stats.docs_read += part.missing
            stats.docs_written += part.missing - part.refused
            stats.doc_write_failures += part.refused
            for store in (source, target):
                store.put_local(name, {"seq": reached, "docs_read": stats.docs_read, "docs_written": stats.docs_written, "doc_write_failures": stats.doc_write_failures})
        run.staged.delete()
    return stats, reached


class _Batch(NamedTuple):
    """The source's sequence number that it reaches, leaves checked, missing and refused, documents written, the target's
    last number after it, and the folder of its revisions."""

    upto: int
    checked: int
    missing: int
    refused: int
    written: int
    seq: int
    path: str


class _Run(NamedTuple):
    """What a run copies, worked out once for all its batches, onto the state of the target that it was worked out for."""

    staged: Folder
    now: Snapshot
    batches: list[_Batch]


def _pending(source: Store, target: Store, options: Options, since: int, batch: int, validate: Validator | None) -> _Run | None:
    if source.last_seq() <= since:
        return None
    revs, looks = source.revs(), options.selector is not None or callable(options.filter)
    top = revs.where(F.col("seq") > since).agg(F.max("seq")).first()[0]
    if top is None:
        return None
    now, have = target.snapshot(), target.revs()
    target.log.tidy(now.commit)
    staged = target.folder.at("staged-replication")  # in the target's file system: what is finished is renamed
    staged.delete()

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = staged.at(name).path
        rows.write.parquet(path)
        return source.spark.read.schema(rows.schema).parquet(path)

    query = ChangesQuery(since=since, doc_ids=options.doc_ids, selector=options.selector, filter="_selector" if options.selector is not None else options.filter, params=options.query_params)
    found = changes(R.winners(revs, looks), query, revs)
    picked = found.scanned if found.test is None else found.scanned.where(found.test)
    picked = kept(picked.select("id", "seq").repartitionByRange("seq").withColumn("part", F.spark_partition_id()), "picked")
    placed = places(picked, ["part"], ["seq"], "place").withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("bigint")).drop("place")
    own = revs.join(picked.select("id"), "id", "left_semi")
    held = have.select(*R.KEY).distinct().withColumn("held", F.lit(True))
    tips = R.leaf_keys(own).select(*R.KEY).join(placed, "id").join(held, R.KEY, "left")
    tips = kept(tips.withColumn("held", F.coalesce("held", F.lit(False))), "tips")
    said = tips.groupBy("batch").agg(F.max("seq").alias("upto"), F.count("*").alias("checked"), F.count_if(~F.col("held")).alias("missing")).orderBy("batch").collect()
    refused, written = {}, {}
    if any(r["missing"] for r in said):
        lacking = tips.where("not held")
        hashed = R.paths(own.join(lacking.select("id"), "id", "left_semi"), lacking).select(*R.KEY, F.transform("revisions.ids", lambda h, i: F.struct((F.col("num") - i).cast("int").alias("num"), h.alias("hash"))).alias("path"))
        docs = R.whole(revs).drop("seq").join(lacking.select(*R.KEY, "seq", "part", "batch"), R.KEY).join(hashed, R.KEY).select("id", "path", "deleted", "body", "atts", "seq", "part", "batch")
        ids = lacking
        if validate is not None:
            judged = kept(docs.withColumn("__fine", _fine(validate)("id", "deleted", "body")), "docs")
            refused = dict(judged.where("not __fine").groupBy("batch").count().collect())
            docs = ids = judged.where("__fine").drop("__fine")
        ids = ids.select("id", "seq", "part", "batch").distinct()
        written = dict(ids.groupBy("batch").count().collect())
        numbers = places(ids, ["part", "batch"], ["seq", "id"], "place").select("id", (F.col("place") + now.seq).alias("seq"))
        rows = R.new_by_path(have, docs.drop("seq", "part").join(numbers, "id"), ("batch",))
        rows.repartitionByRange("seq").sortWithinPartitions("batch", "seq").write.partitionBy("batch").parquet(staged.at("rows").path)
        if source.folder.at("blobs").parts():
            files = source.spark.read.schema(R.REVS).parquet(staged.at("rows").path).where("atts is not null")
            target.add_blobs(A.used(source.blobs(), files).join(target.blobs().select("digest"), "digest", "left_anti"))
    batches, seq = [], now.seq
    for r in said:
        seq += written.get(r["batch"], 0)
        batches.append(_Batch(r["upto"], r["checked"], r["missing"], refused.get(r["batch"], 0), written.get(r["batch"], 0), seq, staged.at(f"rows/batch={r['batch']}").path))
    last = batches.pop()._replace(upto=top) if batches else _Batch(top, 0, 0, 0, 0, seq, "")
    return _Run(staged, now, [*batches, last])


def _fine(validate: Validator):  # noqa: ANN202
    """Whether a validator lets a document pass."""

    @F.pandas_udf("boolean")
    def test(ids: pd.Series, deleted: pd.Series, bodies: pd.Series) -> pd.Series:
        said = [{**json.loads(b or "{}"), "_id": i, **({"_deleted": True} if d else {})} for i, d, b in zip(ids, deleted, bodies, strict=True)]
        return pd.Series([validate(doc, None) is None for doc in said], dtype=bool)

    return test


def follow(source: Store, target: Store, checkpoint: str, options: Options | None = None, interval: str = "5 seconds", validate: Validator | None = None) -> StreamingQuery:
    """Continuous replication: whatever is committed to the source's log starts a run; the stream's own checkpoint only
    says which commits were seen, the replication's checkpoint what was copied."""

    def each(batch: DataFrame, number: int) -> None:
        replicate(source, target, options, validate=validate)

    return continuous(log_stream(source), each, checkpoint, interval)


class Scheduler:
    """Replication jobs by name and their states; a job runs at most once at a time. Continuous ones go on until stopped."""

    def __init__(self, root: str | None = None) -> None:
        self.root, self.jobs, self.streams = root, {}, {}

    def run(self, name: str, source: Store, target: Store, options: Options | None = None) -> dict:
        if self.state(name) == "running":
            return self.jobs[name]
        job = self.jobs[name] = {"state": "running", "error": None}
        try:
            if options is not None and options.continuous:
                if self.root is None:
                    raise QueryError("bad_request", "a continuous replication needs a folder for its checkpoint")
                self.streams[name] = follow(source, target, f"{self.root}/{name}", options)
                return job
            stats, seq = replicate(source, target, options)
            job |= {"state": "completed", "seq": seq, **asdict(stats)}
        except Exception as bad:  # noqa: BLE001  a job's failure is its state
            job |= {"state": "failed", "error": str(bad)}
        return job

    def state(self, name: str) -> str | None:
        """triggered jobs are running until they are completed, failed or stopped."""
        stream = self.streams.get(name)
        if stream is not None and not stream.isActive:
            self.jobs[name] |= {"state": "failed" if stream.exception() else "stopped", "error": str(stream.exception() or "") or None}
        return self.jobs.get(name, {}).get("state")

    def stop(self, name: str) -> None:
        self.streams[name].stop()
