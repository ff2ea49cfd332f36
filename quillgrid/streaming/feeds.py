"""Change feeds as streams: the commit log is a file source, offsets live in the checkpoint.

The log only grows, whatever is compacted or purged, so a stream goes on over both. A batch says which documents were
touched; what they are now is asked of the store, because the last revision written need not be the winner, and a purge
may have taken it away. Late data needs no watermark: a sequence number, not event time, orders a feed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.operators import revisions as R
from quillgrid.operators.changes import Changes, ChangesQuery, latest
from quillgrid.operators.views import View, build, build_json
from quillgrid.sources.folder import Folder
from quillgrid.sources.indextable import IndexTable
from quillgrid.sources.store import Store


def log_stream(store: Store, most_files: int | None = None) -> DataFrame:
    """Revisions as they are committed to the store."""
    store.log.make()
    reader = store.spark.readStream.schema(R.REVS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", most_files) if most_files else reader
    return reader.parquet(store.log.path)


def present(store: Store, batch: DataFrame, with_body: bool = False) -> DataFrame:
    """The winners, as they are now, of the documents that a batch of revisions touches."""
    own = store.revs().join(batch.select("id").distinct(), "id", "left_semi")
    return R.winners(own, with_body)


def longpoll(store: Store, query: ChangesQuery, timeout: float = 60.0, pause: float = 0.2) -> Changes:
    """Wait for the first change after ``since`` that passes the filter; what there is after ``timeout`` seconds.

    Waiting looks at the log's folder; a job runs only when something was written.
    """
    end, looked = time.monotonic() + timeout, -1
    while True:
        seq = store.last_seq()
        if seq > looked:
            found = store.changes(query)
            if query.since != "now" and not found.rows.isEmpty():
                return found
            query = replace(query, since=found.since) if query.since == "now" else query
            looked = seq
        if time.monotonic() >= end:
            return store.changes(query)
        time.sleep(pause)


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, timeout: float | None = None) -> bool:
    """Drain what is there (longpoll: wait up to ``timeout`` seconds); true if it ended by itself."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        return bool(query.awaitTermination(timeout)) if timeout is not None else query.awaitTermination() is None
    finally:
        query.stop()


def continuous(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "5 seconds") -> StreamingQuery:
    """A feed without end; each trigger is a heartbeat, a restart goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def lines_sink(store: Store, path: str, test: Column | None = None) -> Callable[[DataFrame, int], None]:
    """JSON lines of changes, one folder a batch, so that a repeated batch replaces itself. ``test`` is on winners."""

    def each(batch: DataFrame, number: int) -> None:
        rows = present(store, batch, test is not None)
        rows = rows.where(test) if test is not None else rows
        rows = rows.select("seq", "id", "deleted", F.array(F.concat_ws("-", F.col("num").cast("string"), "hash")).alias("changes"))
        rows.sort("seq").write.mode("overwrite").json(f"{path}/batch={number}")

    return each


def events_text(rows: DataFrame) -> Iterator[str]:
    """Server-sent events of a batch of changes."""
    for r in rows.select("seq", "id", "deleted", "changes").toLocalIterator():
        yield f"data: {json.dumps(r.asDict(recursive=True))}\nid: {r['seq']}\n\n"


def keep_latest(spark: SparkSession, path: str, key: str = "id", seq: str = "seq", most: int = 16) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each key's last row: a batch is added as a part, and ``most`` parts become one."""
    folder = Folder(spark, path)

    def each(batch: DataFrame, number: int) -> None:
        parts = folder.parts()
        n = parts[-1]["n"] + 1 if parts else 1
        folder.write(latest(batch, key, seq), n=n, whole=int(not parts))
        if len(live_parts(folder)) > most:
            folder.write(read_latest(spark, path, key, seq), n=n + 1, whole=1)
            for p in folder.parts():
                if p["n"] < n - most:
                    folder.at(p["path"]).delete()

    return each


def live_parts(folder: Folder) -> list[dict[str, int]]:
    parts = folder.parts()
    return parts[max((i for i, p in enumerate(parts) if p["whole"]), default=0) :]


def read_latest(spark: SparkSession, path: str, key: str = "id", seq: str = "seq") -> DataFrame:
    """What ``keep_latest`` keeps."""
    return latest(spark.read.parquet(*[f"{path}/{p['path']}" for p in live_parts(Folder(spark, path))]), key, seq)


def latest_stream(stream: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The same as a stateful operator: rows (key, seq) whenever a document's last sequence number rises."""

    def advance(key_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        top = state.get[0] if state.exists else -1
        new = max([top, *(int(pdf[seq].max()) for pdf in batches)])
        if new > top:
            state.update((new,))
            yield pd.DataFrame({key: [key_[0]], seq: [new]})

    kind = stream.schema[key].dataType.simpleString()
    picked = stream.select(key, F.col(seq).cast("bigint").alias(seq))
    return picked.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, {seq} bigint", "top bigint", "update", "NoTimeout")


def incremental_view(store: Store, path: str, view: View) -> Callable[[DataFrame, int], None]:
    """A sink that keeps a Python or declared view's rows up to date: what a batch touches is mapped again."""
    table = IndexTable(store.spark, path)

    def each(batch: DataFrame, number: int) -> None:
        now, (_, purge) = store.snapshot(), table.reached()
        changed = batch.select("id").union(store.purged_since(purge).select("id")).distinct()
        own = store.revs().join(changed, "id", "left_semi")
        live = R.winners(own, True).where("not deleted and not startswith(id, '_design/')")
        index = build_json(live.select("id", "seq", F.col("body").alias("doc")), view) if view.map is not None else build(live, view)
        table.update(changed if table.folder.parts() else None, index.rows, now.seq, now.purge)

    return each


def windowed_counts(stream: DataFrame, time: str, size: str, key: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows over a feed, for feeds that carry a timestamp."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(window.alias("window"), key).agg(F.count("*").alias("n"))
