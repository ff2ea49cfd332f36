"""Operator 5, SimHash near-duplicates: multi-index hashing.

A fingerprint is two 32-bit segments. Of two fingerprints that differ in at most two bits, one segment differs in at
most one, so each fingerprint enumerates its segments' Hamming balls of radius one, fetches the matches of a table
keyed by segment and verifies complete distances. Of two segments that differ in one bit, only the one with the
0 there looks the other up: half a ball is enough.

Only distinct fingerprints are linked, so exact copies meet once. A segment value that more than ``bucket`` distinct
fingerprints hold (a large group of near copies) would give pairs by the square of its size. All its holders and
callers are instead linked exactly by meeting points: two fingerprints are within two bits if and only if they share
a point within one bit of both, at most 65 distinct fingerprints share a point, and a point links its fingerprints
to their least. Nothing is capped away, and rows stay in proportion to fingerprints. Components come from
``components``; tables between the steps are written to the shared folder.

``near_duplicates`` links fingerprints alone. ``similar_copies`` finds near duplicates by the similarity of their word
shingles: fingerprints of distinct words, whose segments' balls on both sides reach five bits, give the candidates,
and the shingles themselves decide.

Edge cases: a null, empty or white-space text has fingerprint zero, linked like any other; fewer than three words
are one shingle; texts are taken whole; repeated rows and equal doc_ids each come back; null doc_ids are kept and
never are a component's id unless it has no other; kept columns that are called like an output get an underscore after
their name; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import drop_scratch, fresh, materialize, merging, set_aside, small_batches, table, tidy
from quillgrid.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Distinct fingerprints of one segment value that are still compared one by one.
BUCKET = 24
#: Words of a shingle, and the least similarity of two shingle sets as a fraction, of near duplicates by similarity.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bits by which the distinct words' fingerprints of candidates may differ: two in one segment, three in the other.
RADIUS = 5
#: Nodes of a point that meet all its others.
HUBS = 16
#: Words of 64 bits of a sketch of a shingle set.
SKETCH = 8


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash over word shingles of A-Z lower-cased UTF-8."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=False)]
    return _majority(hashes)


def _majority(hashes: list[int]) -> int:
    """The signed number whose bits are set in over half the hashes."""
    n = len(hashes)
    ones, h = np.zeros(64, np.int64), np.array(hashes, ">u8").view(np.uint8).reshape(n, 8)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def word_print(text: bytes) -> tuple[int, int]:
    """Signed hash of the A-Z lower-cased words in their order, and SimHash of the distinct ones (no words: zero)."""
    words = text.translate(LOWER).split()
    node = xxhash.xxh64(b" ".join(words), 42).digest()
    fp = _majority([xxhash.xxh64_intdigest(w, 42) for w in set(words)]) if words else 0
    return int.from_bytes(node, "big", signed=True), fp


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; fewer words are one shingle, no words none."""
    words = text.translate(LOWER).split()
    spans = range(max(len(words) - shingle, 0) + 1) if words else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in spans], np.uint64)).view(np.int64)


def _with_text(df: DataFrame, text: str, out: str, run: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """df's other columns and those that ``run`` makes of a batch's texts (``out`` is their schema); no shuffle."""
    small_batches(df.sparkSession)
    at, added = df.columns.index(text), T.DataType.fromDDL(out)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = run([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, *made], [*names, *added.names])

    return df.mapInArrow(tidy(mapped), T.StructType([f for f in df.schema.fields if f.name != text] + added.fields))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """df's other columns and the fingerprint of each text as a long; no shuffle."""
    return _with_text(df, text, f"`{out}` bigint", lambda texts: [pa.array([fingerprint(x, shingle) for x in texts], pa.int64())])


def _distance(a: str, b: str | Column) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def _segments() -> list[Column]:
    """The two segments as table keys: the second has bit 32 set."""
    low = F.lit(0xFFFFFFFF)
    return [F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))]


def _half_ball(segment: Column) -> Column:
    """A segment and its neighbours by one bit that is 0 in it."""
    up = [F.when(segment.bitwiseAND(F.lit(1 << i)) == 0, segment.bitwiseOR(F.lit(1 << i))) for i in range(32)]
    return F.array_compact(F.array(segment, *up))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of "at most two differing bits", for distinct values in column fp."""
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # each gives dozens of rows
    first, second = _segments()
    entries = fps.select("fp", F.explode(F.array(first, second)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("b"))
    crowded = materialize(sizes.where(F.col("n") > bucket).select("key"), "crowded")
    single = sizes.where("n = 1").select("key", "b", F.lit(False).alias("crowded"))
    several = sizes.where(F.col("n").between(2, bucket)).select("key")
    several = entries.join(merging(several), "key").select("key", F.col("fp").alias("b"), F.lit(False).alias("crowded"))
    stand_in = crowded.select("key", F.lit(None).cast("long").alias("b"), F.lit(True).alias("crowded"))
    index = single.unionByName(several).unionByName(stand_in)
    calls = fps.select("fp", F.explode(F.concat(_half_ball(first), _half_ball(second))).alias("key"))
    met = calls.join(merging(index), "key").where(F.col("crowded") | ((F.col("fp") != F.col("b")) & (_distance("fp", "b") <= 2)))
    met = materialize(met.select(F.col("fp").alias("a"), "b", "crowded"), "links")
    holders = entries.join(merging(crowded), "key", "left_semi").select(F.col("fp").alias("a"))
    dense = met.where("crowded").select("a").union(holders).distinct()
    point = F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    points = materialize(dense.select("a", F.explode(point).alias("point")), "points")
    shared = points.groupBy("point").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    return met.where("not crowded").select("a", "b").union(points.join(merging(shared), "point").where("a != b").select("a", "b"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), shingle: int = 3) -> DataFrame:
    """doc_id, the columns ``keep``, fp, root (a fingerprint that names the group) and component_id, for each row."""
    body = fresh([doc_id, *keep, "fp", "root", "component_id"], "__body")[0]
    picked = set_aside(df.select(doc_id, *keep, F.col(text).alias(body)), "fp", "root", "component_id")
    doc_id, *keep = picked.columns[:-1]
    marked = materialize(fingerprints(picked, body, shingle=shingle), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min(doc_id).alias("least")), "distinct")
    edges = links(fps.select("fp"))
    roots, done = components(edges, "simhash"), [edges]
    if roots is None:
        label = fps.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    else:
        rooted = materialize(fps.join(merging(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
        least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        label = rooted.join(merging(least), "root").select("fp", "root", "component_id")
        done += [roots, rooted, least]
    label = materialize(label, "labels")
    for used in done:
        drop_scratch(used)
    return marked.join(merging(label), "fp").select(doc_id, *keep, "fp", "root", "component_id")


def _ball(segment: Column) -> Column:
    """A segment and its 32 neighbours by one bit."""
    return F.array(segment, *[segment.bitwiseXOR(F.lit(1 << i)) for i in range(32)])


def _alike(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of the rows (a, b) whose sets are alike enough; ``shingles`` has (node, shingles)."""
    both = pairs.join(shingles.toDF("a", "sa"), "a").join(shingles.toDF("b", "sb"), "b")
    enough = F.size(F.array_intersect("sa", "sb")) * sum(SIMILAR) >= (F.size("sa") + F.size("sb")) * SIMILAR[0]
    return both.where(enough).select("a", "b")


def _sketch(shingles: str = "shingles") -> Column:
    """An array of longs with a bit for each shingle of a set; several may have the same one."""
    word = f"aggregate(filter({shingles}, x -> pmod(x, {SKETCH}) = {{}}), 0L, (m, x) -> m | shiftleft(1L, cast(shiftright(x, 32) & 63 as int)))"
    return F.array(*[F.expr(word.format(i)) for i in range(SKETCH)])


def _can_be_alike(other: Column) -> Column:
    """False only for sets (columns n and sketch, and these of ``other``) that are not alike enough.

    A bit that only one sketch has stands for a shingle at least that the other set lacks, so what is left is the most
    that both can share.
    """

    def shared(n: Column, sketch: Column, against: Column) -> Column:
        lacks = [F.bit_count(sketch[i].bitwiseAND(F.bitwise_not(against[i]))) for i in range(SKETCH)]
        return n - sum(lacks[1:], lacks[0])

    n, sketch = F.col("n"), F.col("sketch")
    most = F.least(shared(n, sketch, other["sketch"]), shared(other["n"], other["sketch"], sketch))
    return most * sum(SIMILAR) >= (n + other["n"]) * SIMILAR[0]


def _with_hubs(members: DataFrame, hubs: int, test: Callable[[Column], Column]) -> DataFrame:
    """members with those of their point's first ``hubs`` nodes that come before them and pass a test, in an array; a
    point's hubs meet its nodes as one row."""
    first = members.where(F.col("rank") <= hubs).groupBy("point").agg(F.collect_list(F.struct(*[c for c in members.columns if c != "point"])).alias("hubs"))
    met = members.join(first, "point").withColumn("hubs", F.filter("hubs", lambda h: (h["rank"] < F.col("rank")) & test(h)))
    return met.where(F.size("hubs") > 0)


def _rare_meetings(nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (node, fp, root) that may be linked across roots, by the rarest shingles of each.

    Sets that are alike enough overlap in at least ``need`` shingles, so their first common one, in the order of frequency,
    stands early in both. A pair is emitted only where what follows that shingle can still reach ``need``.
    """
    part, whole = SIMILAR
    each = nodes.join(shingles, "node").select("node", "fp", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    holders = each.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    order = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    placed = each.join(holders, "token").withColumn("left", F.col("n") - order + 1).where("lo != hi")
    placed = materialize(placed.where(F.col("left") * whole >= F.col("n") * part).select("token", "node", "fp", "root", "n", "left"), "placed")
    small = placed.where(F.col("left") * (part + whole) >= F.col("n") * 2 * part).select("token", *[F.col(c).alias(f"{c}_s") for c in placed.columns[1:]])
    ordered = (F.col("n_s") < F.col("n")) | ((F.col("n_s") == F.col("n")) & (F.col("node_s") != F.col("node")))
    need = F.least("left", "left_s") * (part + whole) >= (F.col("n") + F.col("n_s")) * part
    met = placed.join(small, "token").where(ordered & need & (F.col("root") != F.col("root_s")) & (_distance("fp", "fp_s") <= RADIUS))
    return met.select(F.least("node", "node_s").alias("a"), F.greatest("node", "node_s").alias("b")).distinct()


def similar_links(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], hubs: int = HUBS) -> DataFrame:
    """Verified edges (a, b) between the rows (node, fp), whose components are those of all links.

    A link is a distance of ``RADIUS`` bits at most and a similarity of ``SIMILAR`` at least. Of two such fingerprints a
    segment differs in two bits at most, and then both segments' balls of radius one share a point. ``sets`` gives
    (node, shingles) for a table of nodes. The first ``hubs`` nodes of a point meet all others of it, which is every pair
    of most points; pairs whose sketches show that they can't be alike enough go at once. Nodes of larger points that hold several components after that meet by their rarest shingles, so a
    large group of near copies does not give all its pairs, and no link between components is left out.
    """
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = F.explode(F.concat(*map(_ball, _segments()))).alias("point")
    at = Window.partitionBy("point")
    spread = nodes.select("node", "fp").repartition(width, "node").select("node", "fp", points)
    who = F.struct(F.count("*").over(at).alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).over(at).alias(f"x{i}") for i in range(2)])
    shared = materialize(spread.withColumn("who", who).where("who.n > 1"), "shared")
    first = shared.groupBy("who").agg(F.min("point").alias("point")).select("point")  # points of the same nodes say the same
    members = shared.join(first, "point", "left_semi").select("point", "node", "fp")
    rank = F.row_number().over(at.orderBy(F.xxhash64("node"), "node"))
    members = materialize(members.withColumn("rank", rank), "members")
    drop_scratch(shared)
    near = _with_hubs(members, hubs, lambda h: _distance("fp", h["fp"]) <= RADIUS)
    near = materialize(near.select("point", "node"), "near")
    met_by = members.where(F.col("rank") <= hubs).join(near.select("point").distinct(), "point", "left_semi")
    shingles = materialize(sets(near.select("node").union(met_by.select("node")).distinct()), "shingles")
    marks = shingles.select("node", F.size("shingles").alias("n"), _sketch().alias("sketch"))
    marked = materialize(members.join(marks, "node"), "points")
    met = _with_hubs(marked, hubs, lambda h: (_distance("fp", h["fp"]) <= RADIUS) & _can_be_alike(h))
    met = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("hubs", lambda h: h["node"])))).alias("hubs"))
    met = met.select("node", F.explode("hubs").alias("hub"))
    pairs = materialize(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    edges = materialize(_alike(pairs, shingles), "similar")
    rest, used = members.where(F.col("rank") > hubs), [members, near, marked, pairs, shingles]
    if not rest.isEmpty():
        rest = rest.groupBy("node", "fp").agg(F.collect_list("point").alias("points"))  # 66 at most
        roots = components(edges, "similar")
        if roots is not None:
            used.append(roots := materialize(roots, "roots"))
            rest = rest.join(roots, "node", "left")
        own = F.col("node") if roots is None else F.coalesce("root", "node")
        rest = rest.select(F.explode("points").alias("point"), "node", "fp", own.alias("root"))
        rest = rest.withColumns({"lo": F.min("root").over(at), "hi": F.max("root").over(at)}).where("lo != hi")
        rest = materialize(rest.select("node", "fp", "root").distinct(), "rest")
        late = materialize(sets(rest.select("node")), "shingles")
        more = materialize(_rare_meetings(rest, late), "pairs")
        edges = edges.union(materialize(_alike(more, late), "similar"))
        used += [rest, late, more]
    for done in used:
        drop_scratch(done)
    return edges


def similar_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), hubs: int = HUBS) -> DataFrame:
    """doc_id, the columns ``keep``, node (a text's words), root (a node that names the group) and component_id, for each row.

    Near duplicates by similarity: the distinct words' fingerprints find candidates, shingles of ``SHINGLE`` words
    decide. Texts of the same words in the same order are one node (by a hash of 64 bits); a text without words is the
    copy of every other one.
    """
    body, mark = fresh([doc_id, *keep, "node", "fp", "root", "component_id"], "__body", "__mark")
    picked = set_aside(df.select(doc_id, *keep, F.xxhash64(text).alias(mark), F.col(text).alias(body)), "node", "fp", "root", "component_id")
    doc_id, *keep = picked.columns[:-2]

    def prints(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(c, pa.int64()) for c in zip(*map(word_print, texts), strict=True)] if texts else [pa.array([], pa.int64())] * 2

    marked = materialize(_with_text(picked, body, "node bigint, fp bigint", prints), "prints")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("no"), F.col(doc_id).alias("id"), F.col(mark).alias("mark")))
    nodes = marked.groupBy("node").agg(F.min("fp").alias("fp"), first.alias("m"))
    nodes = materialize(nodes.select("node", "fp", F.col("m.id").alias("least"), F.col("m.mark").alias("text_mark")), "nodes")

    def sets(wanted: DataFrame) -> DataFrame:
        rows = materialize(nodes.join(wanted, "node").select("node", "least", "text_mark"), "wanted")
        found = picked.join(rows, F.col(doc_id).eqNullSafe(F.col("least")) & (F.col(mark) == F.col("text_mark"))).select("node", body)
        hashed = _with_text(found, body, "shingles array<bigint>", lambda texts: [pa.array(map(shingle_hashes, texts), pa.list_(pa.int64()))])
        return hashed.dropDuplicates(["node"])

    roots = components(similar_links(nodes, sets, hubs), "similar")
    if roots is None:
        return marked.join(nodes.select("node", F.col("node").alias("root"), F.col("least").alias("component_id")), "node").select(doc_id, *keep, "node", "root", "component_id")
    rooted = materialize(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    label = rooted.select("node", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return marked.join(materialize(label, "labels"), "node").select(doc_id, *keep, "node", "root", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``similar_copies``: that of least doc_id, of several that of least node and hash."""
    mark, named, chosen_hash = fresh(df.columns, "__hash", "__id", "__h")
    hashed = df.withColumn(mark, F.xxhash64(text))
    found = similar_copies(hashed.select(doc_id, mark, text), doc_id, text, keep=(mark,))
    found = found.where(F.col(doc_id).eqNullSafe(F.col("component_id")))
    chosen = found.groupBy("root", "component_id").agg(F.min(F.struct("node", mark)).alias("m")).select(F.col("component_id").alias(named), F.col("m")[mark].alias(chosen_hash))
    chosen = materialize(chosen.distinct(), "chosen")
    met = hashed.join(chosen, F.col(doc_id).eqNullSafe(F.col(named)) & (F.col(mark) == F.col(chosen_hash)), "left_semi")
    return met.dropDuplicates([doc_id, mark]).drop(mark)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
