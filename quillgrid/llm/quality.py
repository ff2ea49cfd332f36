"""Operator 10, quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text (lengths, character classes, repetition) are standardized, mapped to random Fourier features,
which approximate a Gaussian kernel, and scored by a ridge regression. Its normal equations are sums over partitions,
kept by fold, so that every labelled row also gets a score from the other folds; on those scores, pooled in bins, an
isotonic regression gives probabilities.

The fit uses at most ``SAMPLE`` labelled rows, those of least hash: a documented bound, which holds for repeated ids
too. Their texts are found and measured where they are read, by as many tasks as the corpus has; only statistics
move. Sums of a bounded sample are what reaches the driver; scoring passes over all rows without a shuffle.

Edge cases: a null text is an empty one; empty texts are scored like others; texts are measured whole; labels other
than 0 and 1 and null ids teach nothing; repeated labels count each; without labels of both kinds every score is the
smoothed share of label 1 (0.5 without labels); repeated rows come back; extra columns stay, one that is called like
an output with an underscore after its name; no rows, none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import materialize, set_aside, small_batches, table, tidy
from quillgrid.llm.repetition import repeat_words, word_numbers

#: Labelled rows used, features, kernel width (in standard deviations), ridge strength, folds, bins and seed.
SAMPLE, WIDTH, SCALE, RIDGE, FOLDS, BINS, SEED = 20_000, 256, 4.0, 1.0, 5, 512, 10
THRESHOLD = 0.7
#: Tasks that the sample's statistics are dealt to for the fit.
FIT_TASKS = 8

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _MARK, _STOP, _QUOTE = b"#*$%&|<>{}[]\\^~=_+@/", b"!?", b".,;:", b"\"'()-"
_ENDS = tuple(b.encode() for b in ".!?\"'”»…:;)")
NAMES = ("words", "word_length", "long_words", "short_words", "upper", "digit", "symbol", "mark", "stop", "quote", "wide", "lines", "line_words", "ended", "repeated_lines", "distinct", "top_word", "repeated")


def statistics(text: bytes) -> list[float]:
    """The statistics in NAMES of one UTF-8 text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    share = lambda kind: math.sqrt((len(text) - len(text.translate(None, kind))) / chars)
    wide = len(text) - len(text.translate(None, bytes(range(128, 256))))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip().endswith(_ENDS) for x in lines)
    numbers, distinct = word_numbers(words)
    top = int(np.bincount(numbers).max())
    return [
        math.log1p(n),
        math.log(chars / n),
        math.sqrt(float((lengths > 15).mean())),
        float((lengths <= 3).mean()),
        share(_UPPER),
        share(_DIGIT),
        share(_SYMBOL),
        share(_MARK),
        share(_STOP),
        share(_QUOTE),
        math.sqrt(wide / chars),
        math.log1p(len(lines)),
        math.log(n / len(lines)),
        ended / len(lines),
        1 - len(set(lines)) / len(lines),
        math.log(distinct) / math.log(n + 1),
        math.sqrt(top / n),
        repeat_words(numbers, distinct) / n,
    ]


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """df with the statistics in place of its text."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(stats, pa.list_(pa.float64()))], [*(batch.schema.names[i] for i in keep), out])

    fields = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Model:
    """All that scoring needs; a few hundred kilobytes whatever the input."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        cosines = np.cos(z @ self.waves + self.phase) * math.sqrt(2 / self.waves.shape[1])
        return np.concatenate([cosines, z / SCALE, np.ones((len(z), 1))], 1)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(stats), self.prior)
        return np.interp(self.features(stats) @ self.weights, *self.knots)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order of x with sums and counts; knots for interpolation."""
    blocks: list[list[float]] = []
    for at, s, n in zip(x.tolist(), total.tolist(), count.tolist(), strict=True):
        blocks.append([at * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[0] / b[2] for b in blocks])
    value = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    return at, np.maximum.accumulate(value)


def fit(sample: DataFrame) -> Model:
    """A model for rows (stats, label 0 or 1, fold); their number is bounded by the caller."""
    n = len(NAMES)
    sums = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(n)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]
    one = sample.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *sums).first()
    rows, ones = one["n"], one["ones"] or 0
    rng = np.random.default_rng(SEED)
    waves, phase = rng.normal(size=(n, WIDTH)) / SCALE, rng.uniform(0, 2 * math.pi, WIDTH)
    none = (np.zeros(0), np.zeros(0))
    if ones in (0, rows):
        return Model(np.zeros(n), np.ones(n), waves, phase, np.zeros(0), none, (ones + 1) / (rows + 2))
    mean = np.array([one[f"m{i}"] for i in range(n)])
    spread = np.array([max(one[f"s{i}"], 1e-6) for i in range(n)])
    raw = Model(mean, spread, waves, phase, np.zeros(0), none, ones / rows)
    size = WIDTH + n + 1

    def batch_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stats = batch.column(0).flatten().to_numpy().reshape(-1, n)
        return raw.features(stats), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy()

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((FOLDS, size + 1, size))
        for batch in batches:
            z, y, fold = batch_of(batch)
            for k in range(FOLDS):
                held[k, :size] += z[fold == k].T @ z[fold == k]
                held[k, size] += y[fold == k] @ z[fold == k]
        for k in range(FOLDS):
            yield pa.RecordBatch.from_pydict({"fold": [k], "sums": [held[k].tobytes()]}, pa.schema([("fold", pa.int32()), ("sums", pa.binary())]))

    def solve(folds: list[int]) -> np.ndarray:
        a = sum(parts[k] for k in folds)
        return np.linalg.solve(a[:size] + RIDGE * np.eye(size), a[size])

    picked = sample.select("stats", "label", "fold")
    parts = np.zeros((FOLDS, size + 1, size))
    for r in picked.mapInArrow(tidy(equations), "fold int, sums binary").collect():
        parts[r["fold"]] += np.frombuffer(r["sums"]).reshape(size + 1, size)
    by_fold = np.stack([solve([k for k in range(FOLDS) if k != own]) for own in range(FOLDS)])

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, count, total = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            z, y, fold = batch_of(batch)
            score = np.einsum("ij,ij->i", z, by_fold[fold])
            at = np.clip((score + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            for sums, x in ((ones, y), (count, np.ones(len(y))), (total, score)):
                sums += np.bincount(at, x, BINS)
        yield pa.RecordBatch.from_pydict({"bin": np.arange(BINS), "ones": ones, "n": count, "total": total})

    bins = picked.mapInArrow(tidy(held_out), "bin long, ones double, n double, total double")
    got = sorted(bins.groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect())
    count = np.array([r["n"] for r in got])
    knots = isotonic(np.array([r["total"] for r in got]) / count, np.array([r["ones"] for r in got]), count)
    return Model(mean, spread, waves, phase, solve(list(range(FOLDS))), knots, ones / rows)


def part_of(doc_id: Column, modulus: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` labelled rows of least hash that aren't held out (crc32 of the id mod 4 is 2)."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (part_of(F.col("doc_id"), 4) != 2))
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = usable.select("doc_id", F.col(label).cast("int").alias("label"), order.alias("h")).orderBy("h", "label").limit(sample)
    # at most ``sample`` rows of 20 bytes
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    fold = F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold")
    measured = with_statistics(met.select("text", "label", fold, "h")).orderBy("h", "label", "stats").limit(sample)
    dealt = measured.repartition(FIT_TASKS, "h").sortWithinPartitions("h", "label", "stats")  # by id: copies have equal statistics
    return fit(materialize(dealt.select("stats", "label", "fold"), "labelled"))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, with_text: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """df's other columns (and its text, if asked for), score and predicted, or what ``names`` calls them."""
    small_batches(df.sparkSession)
    df = set_aside(df, *names)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, len(NAMES))
            keep = [i for i in range(batch.num_columns) if with_text or i != at]
            scores = np.clip(model.scores(stats), 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*(batch.schema.names[i] for i in keep), *names])

    fields = [f for f in df.schema.fields if with_text or f.name != text]
    return df.mapInArrow(tidy(run), T.StructType([*fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    marked = docs.select("doc_id", (part_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return score(marked, model)
