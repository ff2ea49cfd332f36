"""Operator 3, WARC: resolving not-modified revisits.

A revisit record (server said 304) has no body. It gets that of the latest earlier full response of the same
canonical URL (an as-of join), if the validators agree: entity tags by weak comparison where both have one, else the
last-modified dates where both have one. The stored headers are then updated by the revisit's, except for those
that a 304 must not replace (RFC 9111, 3.2 and 4.3.4).

The as-of join runs in two steps: inside slices of time of a URL by a window, and over the last full response of
each slice for what its own slice doesn't answer. A hot URL is thus spread over its slices, and only record ids and
dates go through windows; bodies are joined once, by record id, which Spark can split where one body is hot.

Edge cases: equal dates go by record id; records without URL, date or id resolve nothing and, as revisits, are
"unmatched"; a revisit without usable validators is "unverified"; one whose latest earlier response has other
validators is "mismatch" (older ones are not tried: the server compared with its newest); header names compare
without case and null headers count as none; a response without body or with another status than 200 is not full;
of records of one id and kind (full response or revisit) the least counts, so reruns agree; a response of a revisit's
date and id is not earlier; extra columns stay on the revisit's row, one that is called like an output with an
underscore after its name; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgrid.llm.common import fresh, materialize, set_aside, table

SLICE_SECONDS = 3600
#: Header fields that describe the body sent or the connection, which a 304 does not replace.
NOT_REPLACED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def no_headers() -> Column:
    return F.create_map().cast(T.MapType(T.StringType(), T.StringType()))


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www.", user info and default port; no scheme, fragment or trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    path, query = F.regexp_extract(rest, "^[^?]*", 0), F.regexp_extract(rest, "[?].+$", 0)
    return F.concat(host, F.regexp_replace(path, "/+$", ""), query)


def _lower_keys(headers: Column) -> Column:
    entries = F.transform(F.map_entries(F.coalesce(headers, no_headers())), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    firsts = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    pick = F.transform(firsts, lambda k: F.struct(k.alias("key"), F.filter(entries, lambda e: e["key"] == k)[0]["value"].alias("value")))
    return F.map_from_entries(pick)


def latest_full(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(record_id, full_id): for each revisit the latest earlier full response of its URL. Columns: url, at, record_id, full."""
    spot = F.struct("at", "record_id")
    cut = records.withColumn("slice", F.floor(F.unix_micros("at") / (slice_seconds * 1_000_000)))
    order = Window.partitionBy("url", "slice").orderBy("at", "record_id", "full")
    inside = cut.withColumn("found", F.last(F.when(F.col("full"), spot), True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    revisits = inside.where("not full")
    slices = cut.groupBy("url", "slice").agg(F.max(F.when(F.col("full"), spot)).alias("last"))
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("url", "slice", F.last("last", True).over(before).alias("carried"))
    asked = revisits.join(slices, ["url", "slice"], "left")
    return asked.select("record_id", F.coalesce("found", "carried")["record_id"].alias("full_id"))


def one_of_each(records: DataFrame, kind: Column) -> DataFrame:
    """records with one row for each (record_id, kind) that has an id: that of least date, URL, status, headers and body.

    Ids that are repeated are found without bodies; only their rows, few in a sane archive, are then compared whole.
    Rows without id all stay.
    """
    mark = fresh(records.columns, "__kind")[0]
    marked = records.withColumn(mark, kind)
    counts = marked.where("record_id is not null").groupBy("record_id", mark).count()
    repeated = materialize(counts.where("count > 1").select("record_id", mark), "repeated")
    single = marked.join(repeated, ["record_id", mark], "left_anti")
    rank = F.struct("warc_date", "target_uri", "status", F.to_json(F.array_sort(F.map_entries(F.coalesce("headers", no_headers())))), F.xxhash64("body"), "body")
    again = marked.join(repeated, ["record_id", mark], "left_semi").groupBy("record_id", mark).agg(F.min_by(F.struct(*records.columns), rank).alias("r"))
    return single.select(*records.columns).unionByName(again.select(*[F.col("r")[c].alias(c) for c in records.columns]))


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Revisits with outcome (resolved, mismatch, unverified, unmatched), matched_id, headers and body.

    Columns of ``records``: record_id, warc_type, target_uri, warc_date, status, headers (a map), body.
    """
    records = set_aside(records, "outcome", "matched_id", "canonical_url")
    stored, body, old, new = fresh(records.columns, "__stored", "__body", "__old", "__new")
    is_full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("body").isNotNull(), F.lit(False))
    wanted = one_of_each(records.where(is_full | (F.col("warc_type") == "revisit")), is_full)
    usable = F.col("target_uri").isNotNull() & F.col("warc_date").isNotNull() & F.col("record_id").isNotNull()
    spots = wanted.where(usable).select(canonical_url(F.col("target_uri")).alias("url"), F.col("warc_date").cast("timestamp").alias("at"), "record_id", is_full.alias("full"))
    found = latest_full(spots, slice_seconds).where("full_id is not null").withColumnRenamed("full_id", "matched_id")
    revisits = wanted.where(F.col("warc_type") == "revisit").drop("body")
    nameless = revisits.where("record_id is null").withColumn("matched_id", F.lit(None).cast(records.schema["record_id"].dataType))
    # revisits without a match stay out of the join with bodies, where their null would be a hot key
    matched = materialize(revisits.where("record_id is not null").join(found, "record_id", "left").unionByName(nameless), "revisits")
    bodies = wanted.where(is_full & F.col("record_id").isNotNull()).select(F.col("record_id").alias("matched_id"), F.col("headers").alias(stored), F.col("body").alias(body))
    without = matched.where("matched_id is null").withColumn(stored, no_headers()).withColumn(body, F.lit(None).cast(records.schema["body"].dataType))
    met = matched.where("matched_id is not null").join(bodies, "matched_id").unionByName(without)
    met = met.withColumn(old, _lower_keys(F.col(stored))).withColumn(new, _lower_keys(F.col("headers")))
    tag = lambda c: F.regexp_replace(F.trim(F.col(c)["etag"]), "^W/", "")
    date = lambda c: F.trim(F.col(c)["last-modified"])
    agrees = F.when(tag(old).isNotNull() & tag(new).isNotNull(), tag(old) == tag(new)).when(date(old).isNotNull() & date(new).isNotNull(), date(old) == date(new))
    outcome = F.when(F.col("matched_id").isNull(), "unmatched").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    permitted = F.map_filter(new, lambda k, v: ~k.isin(*NOT_REPLACED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    met = met.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    met = met.withColumn("headers", F.when(done, merged).otherwise(F.col(new))).withColumn("body", F.when(done, F.col(body)))
    return met.withColumn("canonical_url", canonical_url(F.col("target_uri"))).drop(stored, body, old, new)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records for every page: its response; a revisit two days on by another spelling of the URL; for every
    third page one with another entity tag, for every fourth a newer response between, for every fifth a revisit
    before any response, for every seventh one that has only a date."""
    n = F.col("page_id")
    start = F.timestamp_seconds(F.lit(1_600_000_000) + n * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    since = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss")
    spelt = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))

    def record(k: int, kind: str, uri: Column, hours: int, status: int, headers: list[Column], body: Column) -> Column:
        return F.struct((n * 8 + k).alias("record_id"), F.lit(kind).alias("warc_type"), uri.alias("target_uri"), (start + F.expr(f"INTERVAL {hours} HOURS")).alias("warc_date"), F.lit(status).alias("status"), F.create_map(*headers).alias("headers"), body.alias("body"))

    none = F.lit(None).cast("string")
    x = F.lit
    all_ = [
        (x(True), record(0, "response", F.col("url"), 0, 200, [x("ETag"), tag, x("Last-Modified"), since, x("Content-Type"), x("text/html"), x("Cache-Control"), x("no-cache")], F.col("html"))),
        (x(True), record(1, "revisit", spelt, 48, 304, [x("etag"), F.concat(x("W/"), tag), x("Cache-Control"), x("max-age=60"), x("Content-Type"), x("text/plain")], none)),
        (n % 3 == 0, record(2, "revisit", F.col("url"), 47, 304, [x("ETag"), x('"other"')], none)),
        (n % 4 == 0, record(3, "response", F.col("url"), 24, 200, [x("ETag"), x('"newer"'), x("Content-Type"), x("text/html")], F.concat("html", x("<!-- newer -->")))),
        (n % 5 == 0, record(4, "revisit", F.col("url"), -1, 304, [x("ETag"), tag], none)),
        (n % 7 == 0, record(5, "revisit", F.col("url"), 12, 304, [x("Last-Modified"), since, x("Age"), x("9")], none)),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(when, x(False)), r) for when, r in all_]))
    return pages.select("page_id", F.explode(each).alias("r")).select("page_id", "r.*")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = records_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = resolve_revisits(records.drop("page_id"))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return found.select("record_id", "matched_id", "outcome", "canonical_url", flat.alias("headers"), F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("body_chars"))


OP3_SQL = r"""
WITH canon AS (
  SELECT page_id, url, html, '"' || substring(md5(html), 1, 16) || '"' AS tag,
         to_timestamp(1600000000 + page_id * 60)::TIMESTAMP AS start_at,
         strftime(make_timestamp((1600000000 + page_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') AS since,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare
  FROM pages),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '')
         || regexp_replace(regexp_extract(regexp_extract(bare, '^[^/?]*(.*)$', 1), '^[^?]*'), '/+$', '')
         || regexp_extract(regexp_extract(bare, '^[^/?]*(.*)$', 1), '[?].+$') AS canonical_url,
         1600000000 + page_id * 60 AS sec FROM canon),
fulls AS (
  SELECT page_id * 8 AS record_id, canonical_url, sec AS at, tag AS etag, since AS lm, 'no-cache' AS cc, html AS body FROM keyed
  UNION ALL
  SELECT page_id * 8 + 3, canonical_url, sec + 24 * 3600, '"newer"', NULL, NULL, html || '<!-- newer -->' FROM keyed WHERE page_id % 4 = 0),
revisits AS (
  SELECT page_id * 8 + 1 AS record_id, canonical_url, sec + 48 * 3600 AS at, tag AS etag, NULL AS lm,
         ['cache-control=max-age=60'] AS perm, 'cache-control=max-age=60|content-type=text/plain|etag=W/' || tag AS own, ['etag=W/' || tag] AS ptag FROM keyed
  UNION ALL
  SELECT page_id * 8 + 2, canonical_url, sec + 47 * 3600, '"other"', NULL, [], 'etag="other"', ['etag="other"'] FROM keyed WHERE page_id % 3 = 0
  UNION ALL
  SELECT page_id * 8 + 4, canonical_url, sec - 3600, tag, NULL, [], 'etag=' || tag, ['etag=' || tag] FROM keyed WHERE page_id % 5 = 0
  UNION ALL
  SELECT page_id * 8 + 5, canonical_url, sec + 12 * 3600, NULL, since, ['age=9', 'last-modified=' || since], 'age=9|last-modified=' || since, [] FROM keyed WHERE page_id % 7 = 0),
pairs AS (
  SELECT r.record_id, f.record_id AS matched_id, row_number() OVER (PARTITION BY r.record_id ORDER BY f.at DESC, f.record_id DESC) AS k
  FROM revisits r JOIN fulls f ON f.canonical_url = r.canonical_url AND (f.at < r.at OR (f.at = r.at AND f.record_id < r.record_id))),
joined AS (
  SELECT r.*, f.record_id AS matched_id, f.etag AS fetag, f.lm AS flm, f.cc AS fcc, f.body,
         CASE WHEN f.record_id IS NULL THEN 'unmatched'
              WHEN r.etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN r.etag = f.etag THEN 'resolved' ELSE 'mismatch' END
              WHEN r.lm IS NOT NULL AND f.lm IS NOT NULL THEN CASE WHEN r.lm = f.lm THEN 'resolved' ELSE 'mismatch' END
              ELSE 'unverified' END AS outcome
  FROM revisits r LEFT JOIN (SELECT * FROM pairs WHERE k = 1) p ON p.record_id = r.record_id LEFT JOIN fulls f ON f.record_id = p.matched_id)
SELECT record_id, matched_id, outcome, canonical_url,
       CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_concat(list_concat(perm, ptag), list_filter(
         ['cache-control=' || fcc, 'content-type=text/html', 'etag=' || fetag, 'last-modified=' || flm],
         lambda x: x IS NOT NULL AND NOT list_contains(list_transform(list_concat(perm, ptag), lambda y: split_part(y, '=', 1)), split_part(x, '=', 1))))), '|')
       ELSE own END AS headers,
       CASE WHEN outcome = 'resolved' THEN md5(body) END AS body_md5,
       CASE WHEN outcome = 'resolved' THEN length(body) END AS body_chars
FROM joined
"""
