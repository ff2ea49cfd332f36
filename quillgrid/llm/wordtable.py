"""The distinct-word table: texts as codes into per-block vocabularies, and words looked up once each.

A text is cut at ASCII white space. Every block (some MB of text of one task) has a vocabulary of its distinct
words; its texts become arrays of codes. Vocabularies are dealt into buckets by a hash of the word, so that all
blocks' entries for a word meet in one bucket, where the word is looked up (encoded, counted) once. The answers go
back to their block, and the codes turn them into answers by position. What is shuffled is the compressed codes and
one entry for each word and block, never one row for each word occurrence. A word as frequent as "the" has one
entry a block, so no key is hot.

``encode_blocks`` -> ``answer_words`` -> ``apply_answers``
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import materialize, shuffle_width, small_batches, tidy

#: Bytes of text that share a vocabulary, and bytes of text in one row of codes.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20

BLOCKS = "block string, bucket int, part int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, by byte planes so that zstd finds the small ones' zeros."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        out.append(len(a).to_bytes(8, "little") + planes.tobytes())
    return zstandard.compress(b"".join(out), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))
        at += 8 + 4 * n
    return out


class _Block:
    def __init__(self, name: str, buckets: int, count: int | None = None):
        self.name, self.buckets, self.bytes, self.parts, self.count = name, buckets, 0, [], count
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.counted: list[np.ndarray | None] = []
        self.fresh()

    def fresh(self) -> None:
        self.rows, self.lengths, self.codes, self.chunk = [], [], [], 0

    def add(self, row: pa.RecordBatch, text: bytes) -> None:
        words = text.split()
        self.rows.append(row)
        self.lengths.append(len(words))
        self.codes.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.uint32, len(words)))
        self.bytes += len(text)
        self.chunk += len(text)
        if self.chunk >= CHUNK_BYTES:
            self.cut()

    def cut(self) -> None:
        if self.rows:
            keep = pa.Table.from_batches(self.rows).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keep.schema) as w:
                w.write_table(keep)
            self.counted.append(keep.column(self.count).to_numpy() if self.count is not None else None)
            self.parts.append((zstandard.compress(sink.getvalue().to_pybytes(), 3), np.array(self.lengths, np.uint32), np.concatenate(self.codes)))
            self.fresh()

    def _numbers(self, words: int) -> np.ndarray | None:
        """How often each word is in the texts that count."""
        if self.count is None:
            return None
        total = np.zeros(words, np.int64)
        for flags, (_, lengths, codes) in zip(self.counted, self.parts, strict=True):
            total += np.bincount(codes[np.repeat(flags.astype(bool), lengths)], minlength=words)
        return total

    def out(self) -> Iterator[pa.RecordBatch]:
        """Codes are dealt anew, bucket by bucket, so that the buckets' answers in order are the codes' answers."""
        self.cut()
        words = np.empty(len(self.vocabulary), object)
        words[:] = list(self.vocabulary)
        bucket = np.fromiter((crc32(w) % self.buckets for w in self.vocabulary), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        code = np.empty(len(words), np.uint32)
        code[order] = np.arange(len(words), dtype=np.uint32)
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        rows, start, number = [], 0, self._numbers(len(words))
        for end in ends.tolist() if len(words) else []:
            blob = zstandard.compress(b"\n".join(words[order[start:end]]), 3)
            if number is not None:
                blob = len(blob).to_bytes(8, "little") + blob + pack(number[order[start:end]])
            rows.append((self.name, int(bucket[order[start]]), -1, blob))
            start = end
        name = f"{self.name}-{crc32(b' '.join(words))}-{self.bytes}"  # a block that is made anew can't pass for another
        yield _batch([(name, *row[1:]) for row in rows])
        for part, (keep, lengths, codes) in enumerate(self.parts):
            body = pack(lengths, code[codes] if len(codes) else codes)
            yield _batch([(name, -1, part, len(keep).to_bytes(8, "little") + keep + body)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "part", "blob"])


def encode_blocks(df: DataFrame, text: str, keep: list[str], name: str, count: str | None = None, written: bool = False) -> DataFrame:
    """The blocks of df's texts; ``keep`` are the columns that come back with each text. A null text is empty.

    Words and codes are read from separate evaluations, which costs a second scan and no disk. A plan that deals rows
    out may deal them otherwise the second time, so such a df is written first; ``written`` writes the blocks instead,
    for a df that is dear to evaluate. With ``count``, a boolean column of keep without nulls, entries also say how
    often each word is in the texts where it is true.
    """
    df = df.select(*dict.fromkeys([*keep, text]))
    if not written and re.search("Exchange|Sort|Limit", df._jdf.queryExecution().executedPlan().toString()):
        df = materialize(df, name)
    small_batches(df.sparkSession)
    buckets = shuffle_width(df.sparkSession, 256)
    text_at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, block = 0, None
        for batch in batches:
            kept = batch.select(range(text_at))
            task = batch.column(text_at + 1)[0].as_py() if len(batch) else None
            for i, raw in enumerate(batch.column(text_at).cast(pa.binary()).to_pylist()):
                if block is None:
                    block = _Block(f"{task}-{n}", buckets, keep.index(count) if count else None)
                block.add(kept.slice(i, 1), raw or b"")
                if block.bytes >= BLOCK_BYTES:
                    yield from block.out()
                    n, block = n + 1, None
        if block is not None:
            yield from block.out()

    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"), F.spark_partition_id().alias("__task"))
    blocks = picked.mapInArrow(tidy(run), BLOCKS)
    return materialize(blocks, name) if written else blocks


def answer_words(blocks: DataFrame, answer: Callable[[Iterator[tuple[str, list[bytes]]]], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """Per bucket, ``answer`` gets (block, words) pairs and gives (block, blob) pairs in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)

        held, bucket = [], None
        for block, b, blob in entries():
            if b != bucket:
                yield from answered(held, bucket)
                held, bucket = [], b
            held.append((block, blob))
        yield from answered(held, bucket)

    def answered(held, bucket) -> Iterator[pa.RecordBatch]:
        rows = []
        for block, blob in answer([(k, v) for k, v in held]):
            rows.append((block, bucket, -1 if block else -2, blob))
            if len(rows) >= 64:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    words = blocks.where("bucket >= 0").repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    return words.sortWithinPartitions("bucket", "block").mapInArrow(tidy(run), BLOCKS)


def answer_counts(blocks: DataFrame) -> DataFrame:
    """Each word's count over all blocks, for each block; and per bucket a row of part -2: words counted, their sum."""

    def answer(held: list[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        total: dict[bytes, int] = defaultdict(int)
        for _, blob in held:
            words, numbers = counted_words(blob)
            for w, n in zip(words, numbers.tolist(), strict=True):
                total[w] += n
        for block, blob in held:
            words = counted_words(blob)[0]
            yield block, zstandard.compress(np.fromiter(map(total.__getitem__, words), "<u8", len(words)).tobytes(), 3)
        seen = [n for n in total.values() if n]
        yield "", len(seen).to_bytes(8, "big") + sum(seen).to_bytes(8, "big")

    return answer_words(blocks, answer)


def counted_words(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    return words_of(blob[8 : 8 + n]), unpack(blob[8 + n :])[0]


def words_of(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b"\n")


def apply_answers(blocks: DataFrame, answers: DataFrame, merge: Callable[[list[bytes]], object], rebuild: Callable[[object, pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Bring each block's answers and codes together and rebuild its texts' rows.

    ``merge`` makes one lookup of a block's answer blobs (in bucket order); ``rebuild`` gets it with the kept
    columns, the number of words of each text and the codes of all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, blobs, lookup, seen = None, [], None, False
        for batch in batches:
            for name, part, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if name != block:
                    block, blobs, lookup, seen = name, [], None, False
                if part < 0:
                    blobs.append(blob)
                    seen = True
                    continue
                if lookup is None:
                    lookup, blobs = merge(blobs), []
                n = int.from_bytes(blob[:8], "little")
                keep = pa.ipc.open_stream(zstandard.decompress(blob[8 : 8 + n])).read_all()
                lengths, codes = unpack(blob[8 + n :])
                if len(codes) and not seen:
                    raise RuntimeError(f"block {name} has no words: its table was read in another order")
                yield rebuild(lookup, keep, lengths, codes)

    both = answers.unionByName(blocks.where("bucket < 0"))
    both = both.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    return both.sortWithinPartitions("block", "part", "bucket").mapInArrow(tidy(run), schema)
