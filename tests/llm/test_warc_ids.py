from datetime import datetime

from quillgrid.llm import warc


def test_every_revisit_without_an_id_comes_back(spark):
    day, kind = datetime(2024, 1, 1), "record_id bigint, warc_type string, target_uri string, warc_date timestamp, status int, headers map<string,string>, body string"
    rows = [(None, "revisit", "http://x.org/a", day, 304, None, None)] * 3 + [(1, "revisit", "http://x.org/a", day, 304, None, None)] * 2
    got = warc.resolve_revisits(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r["record_id"] or 0, r["outcome"]) for r in got) == [(0, "unmatched")] * 3 + [(1, "unmatched")]


def test_repeated_ids_are_settled_by_a_total_order(spark):
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    kind = "record_id bigint, warc_type string, target_uri string, warc_date timestamp, status int, headers map<string,string>, body string, outcome string"
    rows = [
        (1, "response", "http://x.org/a", a, 200, {"etag": "v"}, "late", "mine"),
        (1, "response", "http://x.org/a", a, 200, {"etag": "v"}, "early", "mine"),
        (1, "revisit", "http://x.org/a", b, 304, {"etag": "v"}, None, "mine"),
        (1, "revisit", "http://x.org/a", a, 304, {"etag": "w"}, None, "mine"),
        (2, "revisit", "http://x.org/a", b, 304, {"etag": "v"}, None, "mine"),
    ]
    seen = set()
    for order in (rows, rows[::-1]):
        for parts in (1, 4):
            got = warc.resolve_revisits(spark.createDataFrame(order, kind).repartition(parts)).collect()
            seen.add(tuple(sorted((r["record_id"], r["outcome"], r["matched_id"] or 0, r["body"] or "", r["outcome_"]) for r in got)))
    assert len(seen) == 1
    one, two = seen.pop()
    assert one == (1, "unmatched", 0, "", "mine") and two[:3] == (2, "resolved", 1) and two[3] in ("late", "early")
