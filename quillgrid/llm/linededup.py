"""Operator 2, line dedup by site-relative frequency.

Pages are grouped by host; a line's pages are divided by the host's pages, and lines above a boilerplate ratio go
from every page of that host. A page counts a line once. Lines are compared without the white space around them, by
two hashes (96 bits). A line on a single page is shared by no others and stays, however few pages its host has
(``min_pages``).

Counts are partial sums before the shuffle, so a hot host or line is no hot task. A host has at most (its mean
number of lines a page) / ratio lines above the ratio, which bounds the set each page is held against; the sets meet
the pages in a join that Spark broadcasts if its size check allows it, or splits at hot hosts.

Edge cases: a null host is a host of its own; a null text stays null; empty texts and blank lines stay; ties do not
arise; a repeated row is a page of its own; extra columns stay, one that is called like a count with underscores after
its name; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import fresh, materialize, set_aside, table

RATIO, MIN_PAGES = 0.10, 2
_BLANK = " \t\r\x0b\x0c"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _key(line: Column) -> Column:
    bare = _bare(line)
    return F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("g"))


def _host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("-"))


def boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(__host, lines): the hashes of each host's boilerplate lines."""
    pages = df.groupBy(_host_key(host).alias("__host")).agg(F.count("*").alias("pages"))
    bare = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: _bare(x) != ""), _key))
    lines = df.select(_host_key(host).alias("__host"), F.explode(bare).alias("line"))
    counts = lines.groupBy("__host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    above = counts.join(pages, "__host").where(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
    return materialize(above.groupBy("__host").agg(F.collect_list("line").alias("lines")), "boilerplate")


def drop_boilerplate(df: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with ``text`` less its host's boilerplate lines, and the counts __n_lines and __n_dropped."""
    sets = boilerplate(df, host, text, ratio, min_pages)
    df = set_aside(df, "__n_lines", "__n_dropped")
    named, lines, split, left = fresh(df.columns, "__host", "__lines", "__split", "__kept")
    met = df.withColumn(named, _host_key(host)).join(sets.toDF(named, lines), named, "left").withColumn(split, _lines(text))
    kept = F.when(F.col(lines).isNull(), F.col(split)).otherwise(F.filter(split, lambda x: ~F.array_contains(F.col(lines), _key(x))))
    met = met.withColumn(left, kept).withColumn("__n_lines", F.size(split)).withColumn("__n_dropped", F.size(split) - F.size(left))
    return met.withColumn(text, F.array_join(left, "\n")).drop(named, split, left, lines)


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = drop_boilerplate(docs, "source")
    lines = F.coalesce(F.when(F.col("text").isNotNull(), F.col("__n_lines")), F.lit(0)).cast("long")
    dropped = F.coalesce(F.when(F.col("text").isNotNull(), F.col("__n_dropped")), F.lit(0)).cast("long")
    return found.select("doc_id", lines.alias("n_lines"), dropped.alias("n_dropped"), F.md5("text").alias("text_md5"))


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce('h' || source, '-') AS host, text, string_split(text, chr(10)) AS ls,
         list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS bare
  FROM documents),
pages AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(bare)) AS line FROM split) WHERE line <> '' GROUP BY host, line),
boiler AS (
  SELECT host, list(line) AS lines FROM counts JOIN pages USING (host) WHERE n >= 2 AND n > 0.10 * pages GROUP BY host),
kept AS (
  SELECT doc_id, text, len(ls) AS n_lines,
         CASE WHEN lines IS NULL THEN ls
              ELSE list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(lines, bare[i])), lambda i: ls[i]) END AS k
  FROM split LEFT JOIN boiler USING (host))
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - len(k), 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(array_to_string(k, chr(10)), '')) END AS text_md5
FROM kept
"""
