import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

from pyspark.sql import functions as F

from quillgrid.operators.changes import latest
from quillgrid.operators.views import Emit, View, build
from quillgrid.sources.feed import FeedSource
from quillgrid.sources.indextable import IndexTable
from quillgrid.sources.store import Store
from quillgrid.streaming import feeds


def test_feed_sinks_match_the_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    store.bulk([{"_id": f"d{i}", "n": i} for i in range(4)])
    at = f"file://{tmp_path}"
    view = View([Emit(F.get_json_object("body", "$.n").cast("int"))])

    def drain():
        feeds.run_once(feeds.log_stream(store), feeds.keep_latest(spark, f"{at}/latest"), f"{at}/c1")
        feeds.run_once(feeds.log_stream(store), feeds.lines_sink(store, f"{at}/lines"), f"{at}/c2")
        feeds.run_once(feeds.log_stream(store), feeds.incremental_view(store, f"{at}/view", view), f"{at}/c3")

    drain()
    store.put({"_id": "d1", "_rev": store.get("d1")["_rev"], "n": 10})
    store.delete("d2", store.get("d2")["_rev"])
    drain()
    kept = {(r["id"], r["seq"]) for r in feeds.read_latest(spark, f"{at}/latest").collect()}
    assert kept == {(r["id"], r["seq"]) for r in latest(store.revs()).collect()} == {(r["id"], r["seq"]) for r in store.winners().collect()}
    assert spark.read.json(f"{at}/lines").count() == 6
    index = IndexTable(spark, f"{at}/view").read()
    whole = build(store.winners(True).where("not deleted"), view).rows
    assert sorted(r["k0"] for r in index.collect()) == sorted(r["k0"] for r in whole.collect()) == [0, 3, 10]


def test_latest_as_state(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 7), (1, 9)], "id bigint, seq bigint").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, seq bigint").parquet(f"{tmp_path}/in")
    query = feeds.latest_stream(stream).writeStream.format("memory").queryName("tops").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["id"], r["seq"]) for r in latest(spark.table("tops")).collect()} == {(1, 9), (2, 7)}


def test_windows(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:01' + make_interval(0,0,0,0,0,0,id*20) AS ts, 'a' AS k FROM range(6)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, k string").parquet(f"{tmp_path}/in")
    query = feeds.windowed_counts(stream, "ts", "1 minute", "k").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("wins").collect()) == [3, 3]


class Feed(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        since = int(self.path.split("since=")[1].split("&")[0])
        rows = [{"seq": n, "id": f"d{n}", "changes": [{"rev": "1-a"}], "doc": {"n": n}} for n in range(since + 1, min(since + 3, 6))]
        page = {"results": rows, "last_seq": rows[-1]["seq"] if rows else since, "pending": max(0, 5 - since - len(rows))}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(page).encode())

    def log_message(self, *args):
        pass


def test_http_feed(spark):
    server = HTTPServer(("127.0.0.1", 0), Feed)
    Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(FeedSource)
    df = spark.read.format("docfeed").option("url", f"http://127.0.0.1:{server.server_port}/db").load()
    assert sorted(r["id"] for r in df.collect()) == ["d1", "d2", "d3", "d4", "d5"]
    query = spark.readStream.format("docfeed").option("url", f"http://127.0.0.1:{server.server_port}/db").load().writeStream.format("memory").queryName("feed").start()
    try:
        query.processAllAvailable()
        assert spark.table("feed").count() == 5
    finally:
        query.stop()
        server.shutdown()
