"""A Python data source for JSON change feeds over HTTP, batch and streaming; offsets are sequence numbers.

Register with ``spark.dataSource.register(FeedSource)``; options: url (of the database), limit (rows a page), filter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "seq string, id string, deleted boolean, revs array<string>, doc string"


def rows_of(page: dict) -> Iterator[tuple]:
    for r in page.get("results", []):
        doc = r.get("doc")
        yield str(r["seq"]), r["id"], bool(r.get("deleted")), [c["rev"] for c in r.get("changes", [])], None if doc is None else json.dumps(doc)


class _Pages:
    def __init__(self, options: dict):
        self.url, self.limit, self.filter = options["url"].rstrip("/"), int(options.get("limit", "100")), options.get("filter")

    def page(self, since: str) -> dict:
        query = {"since": since, "limit": self.limit, "feed": "normal", "include_docs": "true", **({"filter": self.filter} if self.filter else {})}
        with urlopen(f"{self.url}/_changes?{urlencode(query)}", timeout=60) as answer:
            return json.load(answer)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages, self.since = _Pages(options), options.get("since", "0")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        since = self.since
        while True:
            page = self.pages.page(since)
            yield from rows_of(page)
            if not page.get("results") or not page.get("pending"):
                return
            since = str(page["last_seq"])


class FeedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages, self.since = _Pages(options), options.get("since", "0")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.since}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = self.pages.page(start["seq"])
        rows = list(rows_of(page))
        return iter(rows), {"seq": str(page.get("last_seq", start["seq"])) if rows else start["seq"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        stop = int(end["seq"].split("-")[0])
        since = start["seq"]
        while int(since.split("-")[0]) < stop:
            page = self.pages.page(since)
            if not page.get("results"):
                return
            yield from (r for r in rows_of(page) if int(r[0].split("-")[0]) <= stop)
            since = str(page["last_seq"])


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docfeed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:  # noqa: ANN001
        return FeedReader(self.options)

    def simpleStreamReader(self, schema) -> FeedStream:  # noqa: ANN001, N802
        return FeedStream(self.options)
