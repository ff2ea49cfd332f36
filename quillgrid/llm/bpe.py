"""Operator 1, BPE encoding and decoding: a distinct-word table.

Texts are split into words in Spark, each distinct word is encoded once by the tokenizers library, and the ids are
joined back by position (``wordtable``). Decoding is a join too: the distinct ids of a batch meet the table of ids and
pieces in a hash join, and the pieces go back by position. That table's size is fixed by the tokenizer file and checked
(``MOST_PIECES``), so it is broadcast and no token is shuffled.

Splitting is exact for tokenizers whose pre-tokenizer never joins across ASCII white space, drops it, and whose
normalizer leaves it a boundary (``word_bpe_49k.json`` is one): ``encode`` refuses others.

Edge cases: a null text counts as empty; an empty text or one of white space has no ids and decodes to the empty
string; texts and words of any length are encoded whole; repeated rows give repeated rows; other columns are kept
only if named in ``keep``, one that is called like an output with an underscore after its name; a table without rows
gives none; a null or unknown id decodes to nothing.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import fresh, set_aside, small_batches, table, tidy, utf8
from quillgrid.llm.wordtable import answer_words, apply_answers, encode_blocks, words_of


#: Entries of the largest vocabulary that is broadcast.
MOST_PIECES = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_tokenizer(path: str) -> str:
    """The tokenizer file's JSON, read on the driver; tasks get it with their closure."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    spec["truncation"] = spec["padding"] = None
    if "\\s" not in json.dumps(spec["pre_tokenizer"]) or spec["decoder"] is not None:
        raise ValueError("encoding by distinct words needs a tokenizer that drops white space and joins pieces by spaces")
    return json.dumps(spec, ensure_ascii=False)


@functools.lru_cache(maxsize=2)
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def _merge(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n = int.from_bytes(raw[:4], "little")
        counts.append(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))
        ids.append(np.frombuffer(raw, "<u4", -1, 4 + 4 * n).astype(np.int32))
    counts = np.concatenate(counts)
    return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(ids)


def _gather(starts: np.ndarray, flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words by position, and the number of ids of each text."""
    n = starts[codes + 1] - starts[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    at = np.repeat(starts[codes] - (ends - n), n) + np.arange(total)
    bounds = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    upto = np.concatenate([[0], ends])[bounds]
    return flat[at], upto


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None) -> DataFrame:
    """Columns ``keep``, n_tokens and ids of every text."""
    spec = read_tokenizer(tokenizer or default_tokenizer())
    keep = list(dict.fromkeys(keep))
    body = fresh([*keep, "n_tokens", "ids"], "__body")[0]
    df = set_aside(df.select(*keep, F.col(text).alias(body)), "n_tokens", "ids")
    keep = df.columns[:-1]

    def answer(held: list[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        known: dict[bytes, np.ndarray] = {}
        tok = _tokenizer(spec)
        for block, blob in held:
            words = words_of(blob)
            unknown = [w for w in words if w not in known]
            for i in range(0, len(unknown), 4096):
                part = unknown[i : i + 4096]
                for w, e in zip(part, tok.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4")
            got = [known[w] for w in words]
            sizes = np.fromiter(map(len, got), "<u4", len(got))
            yield block, zstandard.compress(len(got).to_bytes(4, "little") + sizes.tobytes() + np.concatenate(got).tobytes(), 3)

    def rebuild(lookup, kept: pa.Table, lengths: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        ids, upto = _gather(*lookup, lengths, codes)
        arrays = [kept.column(i).combine_chunks() for i in range(len(keep))]
        arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        arrays += [pa.array(np.diff(upto)), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))]
        return pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "ids"])

    blocks = encode_blocks(df, body, keep, "bpe")
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return apply_answers(blocks, answer_words(blocks, answer), _merge, rebuild, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """df with a column of the text that the library's decode(ids, skip_special_tokens=False) gives."""
    spark = df.sparkSession
    small_batches(spark)
    df = set_aside(df, text)
    pieces = spark.sparkContext.broadcast(piece_table(tokenizer or default_tokenizer()))
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            said = _pieces_of(lists.flatten().cast(pa.int64()), pieces.value)
            upto = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
            known = said.is_valid()
            if not pc.all(known).as_py():
                upto = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])[upto]
                said = said.drop_null()
            texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), said), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*batch.schema.names, text])

    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    return df.mapInArrow(tidy(run), schema)


def piece_table(path: str) -> pa.Table:
    """The tokenizer's table of ids and pieces."""
    spec = json.loads(read_tokenizer(path))
    vocabulary = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    if len(vocabulary) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {len(vocabulary)} pieces is too large to send to every task")
    return pa.table({"id": pa.array(vocabulary.values(), pa.int64()), "piece": pa.array(vocabulary.keys(), pa.string())})


def _pieces_of(ids: pa.Array, pieces: pa.Table) -> pa.Array:
    """The piece of each id, null for a null or unknown one: a hash join of the distinct ids with the pieces."""
    coded = ids.dictionary_encode()
    asked = pa.table({"id": coded.dictionary, "at": pa.array(np.arange(len(coded.dictionary)))})
    met = asked.join(pieces, "id", join_type="left outer", use_threads=False).sort_by("at")
    return met["piece"].combine_chunks().take(coded.indices)


def op1_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every document; ids and the decoded text as digests."""
    coded = encode(table(spark, sf_dir, "documents"), tokenizer=tokenizer)
    coded = coded.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256))
    decoded = decode(coded, tokenizer=tokenizer)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(utf8(F.col("decoded")), 256).alias("decoded_sha256"))
