"""Operator 4, quality rules: repetition coverage.

Rolling hashes of several n-gram lengths (numpy) mark the words inside n-grams that the text already had; their
share of the text's word characters, and the share inside repeated lines, decide. The limits are those published for
web corpora: 15 % of the characters for 5-grams, one percent less for each word more, and a fifth for repeated lines.
A long n-gram that comes back weighs more than a short one, so each length can reject alone. The base rules are exact
counts.

A hash covers word numbers, which are exact within a text, by a polynomial modulo 2^64; n-grams of at most ten words
that differ collide with a probability of about 2^-64 a pair. The base rule's 3-word windows are compared exactly.

Edge cases: a null text counts as one without words (all counts 0, base_failed, not kept); empty and white-space
texts likewise; texts of any length are measured whole, each on its own, so memory follows the longest text of a
batch; repeated rows give repeated rows; other columns stay, one that is called like a measure with an underscore
after its name; no rows give none.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillgrid.llm.common import WORD, set_aside, small_batches, table, tidy

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: The largest share of characters inside repeated n-grams of each length, and inside repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS, REPEAT_PERCENT = 50, 50

_BASE = np.uint64(0x9E3779B97F4A7C15)
_find = re.compile(WORD).findall

FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("dup_line_chars", T.LongType()), *((f"dup_{n}gram_chars", T.LongType()) for n in NGRAM_LIMITS)]


def _mix(x: np.ndarray) -> np.ndarray:
    """Word numbers to well-spread 64-bit values (the splitmix64 finalizer)."""
    x = (x + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Of each word, whether a marked window of n words holds it."""
    edge = np.zeros(len(windows) + n, np.int32)
    edge[: len(windows)] += windows
    edge[n:] -= windows
    return np.cumsum(edge)[:-1] > 0


def word_numbers(words: list[str]) -> tuple[np.ndarray, int]:
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number)


def repeat_words(numbers: np.ndarray, distinct: int, n: int = 3) -> int:
    """Words in n-word windows found twice or more, the first included; exact."""
    if len(numbers) <= n:
        return 0
    keys, size = numbers[: len(numbers) - n + 1], distinct
    for k in range(1, n):
        if size * distinct >= 2**62:
            keys = np.unique(keys, return_inverse=True)[1]
            size = int(keys.max()) + 1
        keys, size = keys * distinct + numbers[k : len(numbers) - n + 1 + k], size * distinct
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    return int(_covered(twice, n).sum()) if twice.any() else 0


def ngram_coverage(numbers: np.ndarray, lengths: np.ndarray, sizes: Iterator[int]) -> dict[int, int]:
    """Characters of words inside an n-gram that the text had before, for each n, by rolling hashes."""
    out, value = {}, _mix(numbers.astype(np.uint64))
    rolling, held, found = value, 1, True
    for n in sorted(sizes):
        if not found or len(numbers) <= n:  # without a repeated n-gram there is no repeated longer one
            out[n] = 0
            continue
        for k in range(held, n):
            rolling = rolling[:-1] * _BASE + value[k:]
        held = n
        order = np.argsort(rolling, kind="stable")
        again = np.zeros(len(rolling), bool)
        again[order[1:]] = rolling[order[1:]] == rolling[order[:-1]]
        found = bool(again.any())
        out[n] = int(lengths[_covered(again, n)].sum()) if found else 0
    return out


def measure(text: str | None) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    words = _find(text)
    chars = len(text) - sum(map(text.count, BLANKS))
    numbers, distinct = word_numbers(words)
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line) - sum(map(line.count, BLANKS))
            seen.add(line)
    repeated = repeat_words(numbers, distinct)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    cover = ngram_coverage(numbers, lengths, NGRAM_LIMITS) if repeated else dict.fromkeys(NGRAM_LIMITS, 0)
    failed = len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    kept = not failed and dup_line_chars <= LINE_LIMIT * chars and all(cover[n] <= most * chars for n, most in NGRAM_LIMITS.items())
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated, failed, kept, dup_line_chars, *cover.values())


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures and verdicts of FIELDS; no shuffle."""
    small_batches(df.sparkSession)
    names = [n for n, _ in FIELDS]
    df = set_aside(df, *names)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_() if isinstance(t, T.BooleanType) else pa.int64() for _, t in FIELDS]
        for batch in batches:
            rows = [measure(x) for x in batch.column(at).cast(pa.string()).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*batch.schema.names, *names])

    return df.mapInArrow(tidy(run), schema)


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text")


def repetition_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_repetition that SQL can count."""
    return op4_repetition(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM t)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM grams JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
