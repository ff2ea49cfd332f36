r"""Operator 7, language-model scoring: a probabilistic suffix tree.

A text's tokens are its words (A-Z lower-cased) and one end. The tree models them as a sequence of symbols: the bytes
of the words with a space between two and a line feed for the end; no word holds either. Contexts are the last 0 to
``DEPTH`` symbols, which may reach back to the text's start (a line feed) but not beyond.

* Texts are written in blocks. A block's distinct windows (a context of ``DEPTH`` symbols and the next symbol) go, with
  their counts in training texts, to buckets named by the ``NEAR`` nearest context symbols. Longer contexts are complete
  in one bucket; shorter ones, bounded by the alphabet, are summed over all.
* A context is kept if it is seen ``LEAST`` times, if its next-symbol distribution diverges from that of its suffix by
  at least ``DIVERGENCE`` nats (a Kullback-Leibler test), and by ``EVIDENCE`` nats in all for each symbol kind seen in
  it, without which rare contexts would be kept for their noise. None of these depends on the size of the input, and
  no task or driver holds the whole tree: it grows with the texts.
* Distributions are smoothed towards the suffix's, in proportion to the distinct symbols seen (Witten and Bell), the
  empty context's towards all 256 bytes, so that every text has a probability.
* A bucket answers each block's windows by the longest kept context; the answers meet the texts in their block. They
  travel with 18 significant bits: each symbol's log probability is right to 4 in a million.

The base score needs each word's training count: ``wordtable`` counts and looks up distinct words.

Edge cases: a null text is empty, that is, its end only; without training texts all counts are 0 and the base is
log10(1 / 1) a token, the tree the uniform distribution; null ids train and are not held out; a zero byte is the symbol
255, which UTF-8 lacks; texts are scored whole; repeated rows come back and count; extra columns stay, one that is
called like an output with an underscore after its name; no rows, none.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import drop_scratch, materialize, set_aside, shuffle_width, small_batches, table, tidy
from quillgrid.llm.simhash import LOWER
from quillgrid.llm.wordtable import answer_counts, apply_answers, encode_blocks, pack, unpack

DIVERGENCE, EVIDENCE = 0.03, 2.0
#: Symbols of the longest context, and times that a kept context is seen.
DEPTH, LEAST = 6, 2
END, PAD = 10, 0
_SYMBOLS = bytes([255]) + LOWER[1:]
#: Context symbols that decide a window's bucket; contexts of at least as many are complete inside one bucket.
NEAR = 3
#: Bytes of text whose windows are counted at once, and windows held before they are summed.
PIECE, HELD = 8 << 20, 2_000_000
#: Texts whose windows are sorted together: as many as a window's last byte can number.
FEW = 256


def symbols(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_SYMBOLS).split())


@dataclass(frozen=True)
class Level:
    """Contexts of one length: (context, symbol) and their counts, contexts and what is known of each."""

    short: np.ndarray
    n: np.ndarray
    context: np.ndarray
    own: np.ndarray
    kinds: np.ndarray
    kept: np.ndarray


def _mask(k: int) -> np.uint64:
    """A symbol and its k context symbols."""
    return np.uint64((1 << (8 * k + 8)) - 1)


def _whole(keys: np.ndarray, k: int) -> np.ndarray:
    """Whether windows have k context symbols."""
    return (keys >> np.uint64(8 * k)) & np.uint64(0xFF) != PAD


def level(keys: np.ndarray, counts: np.ndarray, k: int, below: Level | None, least: int = LEAST) -> Level:
    """The contexts of k symbols in all the windows that have them; ``below`` has those of k - 1."""
    seen = _whole(keys, k) & (counts > 0)
    short, at = np.unique(keys[seen] & _mask(k), return_inverse=True)
    n = np.bincount(at, counts[seen], len(short))
    context, of = np.unique(short >> np.uint64(8), return_inverse=True)
    own, kinds = np.bincount(of, n, len(context)), np.bincount(of, minlength=len(context))
    if below is None:
        return Level(short, n, context, own, kinds, np.ones(len(context), bool))
    up = np.searchsorted(below.context, context & (_mask(k - 1) >> np.uint64(8)))
    raw, before = n / own[of], below.n[np.searchsorted(below.short, short & _mask(k - 1))] / below.own[up][of]
    gain = np.bincount(of, raw * np.log(raw / before), len(context))
    return Level(short, n, context, own, kinds, (own >= least) & (gain >= DIVERGENCE) & (gain * own >= EVIDENCE * kinds))


def _found(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return at, sorted_[at] == asked


def window_chances(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """The probability of each window's symbol after its longest kept context."""
    chance = np.full(len(keys), 1 / 256)
    out = chance.copy()
    for k, own in enumerate(levels):
        if not len(own.context):
            break
        full = np.flatnonzero(_whole(keys, k))
        short = keys[full] & _mask(k)
        at, known = _found(own.context, short >> np.uint64(8))
        full, short, at = full[known], short[known], at[known]
        here, seen = _found(own.short, short)
        n, kinds = np.where(seen, own.n[here], 0), own.kinds[at]
        chance[full] = (n + kinds * chance[full]) / (own.own[at] + kinds)
        kept = own.kept[at]
        out[full[kept]] = chance[full[kept]]
    return out


def text_windows(texts: list[bytes], order: int, numbers: np.ndarray | None = None) -> np.ndarray:
    """The window of each position, sorted: context symbols from the highest byte on, the nearest first, the symbol itself
    in the last byte but one, and in the last the text's number, if given. At most 6 context symbols fit.

    Sorting is far faster than hashing here, and neighbours in this order share their symbols.
    """
    if not texts:
        return np.zeros(0, np.uint64)
    joined = b"\n" + (b"\n" + bytes(order) + b"\n").join(texts) + b"\n"
    s = np.frombuffer(bytes(order) + joined, np.uint8)
    w = s[order:].astype(np.uint64) << np.uint64(8)
    for back in range(1, order + 1):
        w |= s[order - back : len(s) - back].astype(np.uint64) << np.uint64(64 - 8 * back)
    w = w[(s[order:] != PAD) & (s[order - 1 : -1] != PAD)]  # padding and starts are not predicted
    if numbers is not None:
        w |= np.repeat(numbers, [len(t) + 1 for t in texts]).astype(np.uint64)
    w.sort()
    return w


def runs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each is there."""
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    return w[first], np.diff(first, append=len(w))


def added(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sums of their numbers."""
    at = np.argsort(w, kind="stable")
    w, n = w[at], n[at]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    return w[first], np.add.reduceat(n, first) if len(first) else n


def counted(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of texts, in order, and their counts; positions are held for a few texts at a time."""
    parts = [runs(text_windows(texts[i : i + FEW], order)) for i in range(0, len(texts), FEW)] or [runs(np.zeros(0, np.uint64))]
    return added(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def symbol_first(w: np.ndarray) -> np.ndarray:
    """Windows with the symbol in the lowest byte and the nearest context symbol above it, as levels have them."""
    return (w.byteswap() & np.uint64((1 << 48) - 1)) << np.uint64(8) | (w >> np.uint64(8)) & np.uint64(0xFF)


def by_bucket(w: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each window, and the windows' order by bucket."""
    bucket = ((w >> np.uint64(64 - 8 * NEAR)) * np.uint64(2654435761) >> np.uint64(8)) % np.uint64(buckets)
    bucket = bucket.astype(np.min_scalar_type(buckets))
    return bucket, np.argsort(bucket, kind="stable")


def _halves(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return w >> np.uint64(32), w & np.uint64(0xFFFFFFFF)


def _keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    high, low, n = unpack(blob)
    return high.astype(np.uint64) << np.uint64(32) | low, n.astype(np.int64)


def _summed(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the blobs, in order, and their counts."""
    keys, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for blob in blobs:
        more, n = _keys(blob)
        keys.append(more)
        counts.append(n)
        size += len(more)
        if size > HELD:
            keys, counts = ([x] for x in added(np.concatenate(keys), np.concatenate(counts)))
            size = 0
    return added(np.concatenate(keys), np.concatenate(counts))


WINDOWS = "block string, bucket int, blob binary"


def tree_windows(df: DataFrame, text: str, trains: str, order: int = DEPTH) -> tuple[DataFrame, DataFrame, int]:
    """Blocks of rows, which are written, the windows of each block by bucket, and the number of buckets."""
    spark = df.sparkSession
    small_batches(spark)
    buckets = shuffle_width(spark, 512)
    at, flag = df.columns.index(text), df.columns.index(trains)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for b in held:
                    writer.write_batch(b)
            blob = zstandard.compress(sink.getvalue().to_pybytes(), 3)
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([buckets], pa.int32()), pa.array([blob], pa.binary())], ["block", "bucket", "blob"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.column(at).nbytes
            if size >= PIECE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                rows = block_rows(blob.as_py())
                texts = [symbols(x) for x in rows.column(at).cast(pa.binary()).to_pylist()]
                trained = rows.column(flag).to_numpy(zero_copy_only=False).astype(bool).tolist()
                seen, n = counted([t for t, yes in zip(texts, trained, strict=True) if yes], order)
                asked, _ = counted([t for t, yes in zip(texts, trained, strict=True) if not yes], order)
                w, n = added(np.concatenate([seen, asked]), np.concatenate([n, np.zeros(len(asked), n.dtype)]))
                bucket, places = by_bucket(w, buckets)
                cuts = np.flatnonzero(np.diff(bucket[places].astype(np.int64), prepend=-1))
                blobs = [pack(*_halves(w[x]), n[x]) for x in np.split(places, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cuts)), pa.array(bucket[places][cuts].astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "bucket", "blob"])

    blocks = materialize(df.mapInArrow(tidy(gather), WINDOWS), "pst-blocks")
    return blocks, blocks.mapInArrow(tidy(count), WINDOWS), buckets


def block_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


def short_levels(blocks: DataFrame, at: int, flag: int) -> list[Level]:
    """The contexts of fewer than NEAR symbols: a collected table that only the alphabet bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                rows = block_rows(blob.as_py())
                texts = [symbols(x) for x, yes in zip(rows.column(at).cast(pa.binary()).to_pylist(), rows.column(flag).to_pylist(), strict=True) if yes]
                more, times = counted(texts, NEAR - 1)
                w, n = added(np.concatenate([w, more]), np.concatenate([n, times]))
        yield pa.RecordBatch.from_arrays([pa.array(symbol_first(w).astype(np.int32)), pa.array(n)], ["short", "n"])

    got = blocks.select("blob").mapInArrow(tidy(run), "short int, n bigint").groupBy("short").agg(F.sum("n").alias("n")).toArrow()
    keys, n, levels = got["short"].to_numpy().astype(np.uint64), got["n"].to_numpy(), []
    for k in range(NEAR):
        levels.append(level(keys, n, k, levels[-1] if levels else None))
    return levels


def _bucket_levels(keys: np.ndarray, counts: np.ndarray, short: list[Level], order: int) -> list[Level]:
    levels = list(short)
    for k in range(NEAR, order + 1):
        levels.append(level(keys, counts, k, levels[-1]))
    return levels


def _by_bucket(counted: DataFrame, answer: Callable[[list[tuple[str, bytes]], int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for block, own, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket:
                    if held:
                        yield from answer(held, bucket)
                    bucket, held = own, []
                held.append((block, blob))
        if held:
            yield from answer(held, bucket)

    width = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), schema)


def kept_contexts(df: DataFrame, text: str, trains: str, order: int = DEPTH) -> DataFrame:
    """(k, n): for each bucket, the number of kept contexts of k symbols, NEAR at least."""
    blocks, counted, _ = tree_windows(df, text, trains, order)
    short = df.sparkSession.sparkContext.broadcast(short_levels(blocks, df.columns.index(text), df.columns.index(trains)))

    def answer(held: list[tuple[str, bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
        w, n = _summed(b for _, b in held)
        levels = _bucket_levels(symbol_first(w), n, short.value, order)[NEAR:]
        yield pa.RecordBatch.from_arrays([pa.array(range(NEAR, order + 1), pa.int32()), pa.array([int(x.kept.sum()) for x in levels], pa.int64())], ["k", "n"])

    return _by_bucket(counted, answer, "k int, n bigint")


def tree_scores(df: DataFrame, text: str, trains: str, out: str = "score", order: int = DEPTH) -> DataFrame:
    """df with the log10 probability of each text by the tree of the rows where ``trains`` is true."""
    spark, df = df.sparkSession, set_aside(df, out)
    blocks, counted, buckets = tree_windows(df, text, trains, order)
    at = df.columns.index(text)
    short = spark.sparkContext.broadcast(short_levels(blocks, at, df.columns.index(trains)))

    def answer(held: list[tuple[str, bytes]], bucket: int) -> Iterator[pa.RecordBatch]:
        w, counts = _summed(b for _, b in held)
        keys = symbol_first(w)
        logs = np.log10(window_chances(keys, _bucket_levels(keys, counts, short.value, order))).astype("<f4")
        bits = logs.view("<u4") + np.uint32(0x20) & np.uint32(0xFFFFFFC0)
        for block, blob in held:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([pack(bits[np.searchsorted(w, _keys(blob)[0])])], pa.binary())], ["block", "bucket", "blob"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket < buckets:
                    blobs.append(blob.as_py())
                    continue
                rows = block_rows(blob.as_py())
                texts = [symbols(x) for x in rows.column(at).cast(pa.binary()).to_pylist()]
                done = rows.append_column(out, pa.array(text_scores(texts, blobs, order, buckets)))
                blobs = []
                yield from done.to_batches()

    both = _by_bucket(counted, answer, WINDOWS).unionByName(blocks)
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "bucket")
    return both.mapInArrow(tidy(score), T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def text_scores(texts: list[bytes], answers: list[bytes], order: int, buckets: int) -> np.ndarray:
    """The sum of each text's answers; ``answers`` are those of the block's distinct windows, bucket by bucket."""
    parts = []
    for i in range(0, len(texts), FEW):
        some = texts[i : i + FEW]
        w = text_windows(some, order, np.arange(len(some)))
        parts.append((*runs(w >> np.uint64(8) << np.uint64(8)), (w & np.uint64(0xFF)).astype(np.uint8), len(some)))
    distinct = runs(np.sort(np.concatenate([p[0] for p in parts])))[0]
    logs = np.empty(len(distinct))
    logs[by_bucket(distinct, buckets)[1]] = np.concatenate([unpack(b)[0].view("<f4") for b in answers])
    return np.concatenate([np.bincount(own, np.repeat(logs[np.searchsorted(distinct, w)], n), size) for w, n, own, size in parts])


def base_scores(df: DataFrame, text: str, keep: list[str], trains: str, lower: bool = True, ends: int | None = None) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score: add-one unigrams of the rows where ``trains`` is true, ``ends`` in number."""
    said = ("n_tokens", "n_known", "train_tokens", "base_score")
    renamed = dict(zip(df.columns, set_aside(df, *said).columns, strict=True))
    keep, df = [renamed[c] for c in keep], set_aside(df, *said)
    lowered = df.withColumn(text, F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if lower else df
    blocks = encode_blocks(lowered, text, [trains, *(c for c in keep if c != trains)], "lm", count=trains, written=True)
    answers = materialize(answer_counts(blocks), "lm-counts")
    ends = df.where(F.col(trains)).count() if ends is None else ends
    one = answers.where("part = -2").select(F.expr("cast(conv(hex(substring(blob, 1, 8)), 16, 10) as long)").alias("v"), F.expr("cast(conv(hex(substring(blob, 9, 8)), 16, 10) as long)").alias("n")).agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    distinct, total = (one["v"] or 0) + (ends > 0), (one["n"] or 0) + ends
    unit = math.log10(total + distinct + 1)
    names = [trains, *(c for c in keep if c != trains)]

    def merge(blobs: list[bytes]) -> np.ndarray:
        return np.concatenate([np.frombuffer(zstandard.decompress(b), "<u8") for b in blobs] or [np.zeros(0, np.uint64)])

    def rebuild(lookup: np.ndarray, kept: pa.Table, lengths: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        upto = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        logs, known = np.log10(lookup.astype(np.float64) + 1)[codes], (lookup > 0)[codes]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[upto])
        n = lengths.astype(np.int64) + 1
        base = sums(logs) + math.log10(ends + 1) - n * unit
        columns = [pa.array(kept.column(c).to_pylist(), kept.schema.field(c).type) for c in names]
        columns += [pa.array(n), pa.array(np.rint(sums(known)).astype(np.int64) + (ends > 0)), pa.array(np.full(len(n), total, np.int64)), pa.array(base)]
        return pa.RecordBatch.from_arrays(columns, [*names, *said])

    more = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType())]
    schema = T.StructType([df.schema[c] for c in names] + more)
    return apply_answers(blocks, answers.where("part = -1"), merge, rebuild, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def op7_suffixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    marked = tree_scores(docs.withColumn("trains", ~F.col("held_out")), "text", "trains")
    found = base_scores(marked, "text", ["doc_id", "held_out", "score"], "trains", ends=docs.where("not held_out").count())
    drop_scratch(marked)  # the word blocks are written and hold what the scores were made from
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
