"""Operator 6, mixing sources to target weights: a low-discrepancy source schedule.

Each source's documents stand in a hashed order and are cut into blocks of equal tokens; a source that gives more
than its size starts over. The schedule is a golden-ratio rotation of the integers below M, M being the number of
blocks that all targets need: slot i has the point i * a mod M, with a next to M / phi and coprime to M. Cumulative
weights (blocks needed) cut the points into one interval a source. As the rotation is a permutation, each source
gets exactly the slots that it needs, spread as evenly as the golden ratio allows. Slots are ranked within their
source; rank r takes block r mod (blocks of the source), the last only as far as the target.

The mix is what stands in the slots: slots are joined with the pieces of documents in their blocks, which says how many
words are taken of a document, at which slot first (``mix``), and in which order the documents stand (``taken_rows``).

Slots are made from the sources' intervals by the inverse of a, so no join between slots and intervals is needed.
Ranks and document offsets are prefix sums in two levels (sums of chunks, then inside a chunk), so a source with a
third of all rows is no hot task. The only rows on one task are the sources' own totals.

Edge cases: a null text has size 0; size-0 documents take 0 and have no slot; a null source is a source, last in order;
with all sizes 0 all targets are 0; equal doc_ids are told apart by size and text, and rows equal in all share what they
take in either order; kept columns that are called like an output get an underscore after their name; extra columns
stay on the document in ``taken_rows``; a table without rows gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgrid.llm.common import WORD, drop_scratch, fresh, materialize, set_aside, table, utf8

#: Tokens of a block.
BLOCK = 128
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    return F.regexp_count(utf8(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, sid, target) for (source, source_size): shares by weight, none above ``most`` times its size.

    The excess of the sources at their limit is shared among the others by weight until none is above: sorted by
    limit / weight, a source is at its limit if the total is reached only above its own ratio.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    one = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    one = one.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    one = one.withColumn("full", F.sum("cap").over(upto) + F.col("cap") / F.col("w") * F.coalesce(F.sum("w").over(after), F.lit(0.0)) <= total)
    level = (total - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return one.select("source", "source_size", "sid", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def rotation(m: int) -> tuple[int, int]:
    """a next to m / phi and coprime to m, and its inverse modulo m."""
    if m <= 1:
        return 0, 0
    a = max(1, round(m * GOLDEN))
    while math.gcd(a, m) != 1:
        a += 1
    a %= m
    return a, pow(a, -1, m)


def _times_mod(x: Column, a: int, m: int) -> Column:
    """x * a mod m without overflow for m below 2^40, x being below m."""
    step = 1 << 20
    high, low = F.floor(x / F.lit(step)).cast("long"), x % F.lit(step)
    return (high * F.lit(a * step % m) % F.lit(m) + low * F.lit(a) % F.lit(m)) % F.lit(m)


def _plan(sources: DataFrame, block: int) -> DataFrame:
    """Adds whole (rounded target), blocks, needed and first: the source's interval of points."""
    s, b = F.col("source_size"), F.lit(block)
    whole = F.round("target").cast("long")
    up = lambda x: F.floor((x + b - 1) / b).cast("long")
    one = sources.withColumn("whole", whole).withColumn("blocks", up(s))
    rounds = F.floor(F.col("whole") / F.greatest(s, F.lit(1))).cast("long")
    one = one.withColumn("needed", F.when(s > 0, rounds * F.col("blocks") + up(F.col("whole") - rounds * s)).otherwise(0).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("first", F.coalesce(F.sum("needed").over(before), F.lit(0)).cast("long"))


def schedule(sources: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """The slots: sid, slot (its place in the mix), rank, block, start (in the source's stream) and tokens."""
    _, inverse = rotation(total)
    chunk = max(1024, math.isqrt(total))
    runs = sources.where("needed > 0").withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("needed") - 1, F.lit(chunk).cast("long"))))
    runs = runs.select("sid", "source_size", "whole", "blocks", "first", "needed", "lo").repartition("sid", "lo")
    points = runs.withColumn("j", F.explode(F.sequence("lo", F.least(F.col("lo") + chunk, F.col("needed")) - 1)))
    slot = _times_mod(F.col("first") + F.col("j"), inverse, max(total, 1))
    slots = points.select("sid", "source_size", "whole", "blocks", slot.alias("slot")).withColumn("part", F.floor(F.col("slot") / chunk).cast("long"))
    slots = materialize(slots, "slots")
    counts = slots.groupBy("sid", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(base, ["sid", "part"]).withColumn("rank", F.col("base") + F.col("inside"))
    at = F.floor(F.col("rank") / F.col("blocks")).cast("long") * F.col("source_size") + F.col("rank") % F.col("blocks") * block
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("start", at)
    tokens = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("whole") - F.col("start"))
    return ranked.select("sid", "source_size", "slot", "rank", "block", "start", tokens.cast("long").alias("tokens"))


def _placed(df: DataFrame, doc_id: str, text: str, source: str, block: int, seed: int, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Documents, those with words and their place (sid, start) in their source's stream, what each slot takes of them
    (sid, start, round, slot, words), and the number of slots. A round is one pass through a source."""
    key = F.xxhash64(F.col(doc_id), F.lit(seed))
    docs = df.select(F.col(doc_id).alias("__id"), *keep, F.col(source).cast("string").alias("__source"), word_count(F.col(text)).alias("__size"), key.alias("__key"), F.xxhash64(text).alias("__text"))
    docs = materialize(docs, "mix-docs")
    sizes = docs.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    sources = materialize(_plan(source_targets(sizes), block), "mix-sources")
    total, rows = int(sources.agg(F.sum("needed")).first()[0] or 0), docs.count()
    bits = max(6, math.ceil(math.log2(max(1, rows)) / 2))
    named = docs.join(sources.select(F.col("source").alias("__s"), F.col("sid").alias("__sid"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")), F.col("__source").eqNullSafe(F.col("__s"))).drop("__source", "__s")
    sized = named.where("__size > 0").withColumn("__part", F.shiftrightunsigned("__key", 64 - bits))
    sums = sized.groupBy("__sid", "__part").agg(F.sum("__size").alias("n"))
    before = Window.partitionBy("__sid").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__sid", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__sid", "__part").orderBy("__key", "__id", "__size", "__text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(base, ["__sid", "__part"])
    placed = materialize(placed.withColumn("__start", F.col("__base") + F.col("__inside")).drop("__base", "__inside", "__part", "__key"), "mix-placed")
    slots = schedule(sources, total, block).select("sid", "block", "slot", "tokens", F.floor((F.col("start") - F.col("block") * block) / F.greatest(F.col("source_size"), F.lit(1))).alias("round"))
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    pieces = placed.select(F.col("__sid").alias("sid"), F.col("__start").alias("start"), F.col("__size").alias("size")).withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block), F.col("tokens"))
    given = pieces.join(slots, ["sid", "block"]).select(F.col("sid").alias("__sid"), F.col("start").alias("__start"), "round", "slot", (hi - lo).alias("words")).where("words > 0")
    return named, placed, given, total


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, size, source_size, target, taken (tokens that the mix takes) and first_slot (where
    it takes the first of them, null if none) for each document."""
    shown = set_aside(df.select(*keep), "size", "source_size", "target", "taken", "first_slot").columns
    held = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    bare = df.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__body"), F.col(source).alias("__from"), *held)
    named, placed, given, _ = _placed(bare, "__doc", "__body", "__from", block, seed, [f"__keep{i}" for i in range(len(keep))])
    got = given.groupBy("__sid", "__start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    done = placed.join(got, ["__sid", "__start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    empty = named.where("__size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    cols = [F.col("__id").alias(doc_id), *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(shown)], F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "taken", "first_slot"]
    return done.select(*cols).unionByName(empty.select(*cols))


def taken_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 6) -> DataFrame:
    """The mix itself, as rows of df in the order of the slots: a document at each slot that begins it, cut after its
    last word taken.

    Rows that the mix takes nothing of go. Only where a source's target ends is a document cut, so one at most for
    each source; the cut keeps the white space between words. Partition i has the i-th part of the slots, in order.
    Equal rows are one document of which there are several: any of them stands for the others.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row, row_id, name, words, slot = fresh(df.columns, "__row", "__row_id", "__name", "__words", "__slot")
    whole = df.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in hashable])).withColumn(row_id, F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    _, placed, given, total = _placed(whole.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__body"), F.col(source).alias("__from"), F.col(row).alias("__row"), F.col(row_id).alias("__row_id")), "__doc", "__body", "__from", block, seed, ["__row", "__row_id"])
    passes = given.groupBy("__sid", "__start", "round").agg(F.min("slot").alias(slot), F.sum("words").alias(words))
    named = placed.select("__sid", "__start", F.col("__row").alias(row), F.col("__row_id").alias(row_id), F.col("__size").alias(name))
    wanted = materialize(passes.join(named, ["__sid", "__start"]).select(row, row_id, slot, F.when(F.col(words) < F.col(name), F.col(words)).cast("int").alias(words)), "taken")
    for used in (given, placed):
        drop_scratch(used)
    met = whole.dropDuplicates([row, row_id]).join(wanted, [row, row_id])
    parts = F.split(F.col(text), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # a word and the white space after it
    lead = F.when(F.col(text).rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.rtrim(F.array_join(F.slice(parts, F.lit(1), F.col(words) + lead), ""))
    dealt = met.repartitionById(width, F.floor(F.col(slot) * width / max(total, 1)).cast("int")).sortWithinPartitions(slot, row, row_id)
    return dealt.withColumn(text, F.when(F.col(words).isNull(), F.col(text)).otherwise(cut)).select(*[F.col(f"`{c}`") for c in df.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_mixing that SQL can work out."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS r FROM s),
f AS (SELECT a.*, (SELECT sum(b.cap) FROM o b WHERE b.r <= a.r) + a.cap / a.w * (SELECT coalesce(sum(b.w), 0) FROM o b WHERE b.r > a.r) <= a.total AS at_cap FROM o a),
l AS (SELECT (max(total) - coalesce(sum(cap) FILTER (at_cap), 0)) / sum(w) FILTER (NOT at_cap) AS level FROM f)
SELECT doc_id, size, source_size, round(CASE WHEN at_cap THEN cap ELSE least(cap, level * w) END, 4) AS target
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source, l
"""
