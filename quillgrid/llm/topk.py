"""Operator 8, exact top-k search: columnar branch-and-bound.

Vectors are turned into whole numbers and laid out dimension by dimension. A query takes the dimensions in the order of
its own components, largest first, a few at a time: products are accumulated over the candidates that are left, as are
the squares that they have spent. What is still to come is at most the query's remaining norm times the candidate's
(Cauchy-Schwarz), and candidates that can't reach the query's k-th best so far are compacted away. Every candidate that
can is summed in full, so results are exact.

* A query starts with the k-th best among ``SEEDS`` candidates as its bound, a documented sample that only says where
  pruning begins, and raises it with every block that it meets.
* Candidates stay where they are read: queries come to them in waves of at most ``WAVE_BYTES``, which are broadcast. A
  wave gives k rows a query and task, whatever the number of candidates; a second top-k reduces them. Waves are written
  as they finish.

Edge cases: a null vector, a vector with a null, NaN or infinite component, and a null id take no part; vectors of
different lengths are compared over the shorter's dimensions as if the rest were 0; a query is not its own
candidate (rows of equal id are left out together); repeated candidates each count; of query rows of one id the least
vector asks; ties go to the smaller id; fewer than k candidates give all; a finite component of 2^63 or more after
scaling is an error, as is a score beyond 64 bits; extra columns are ignored; no rows, none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.common import materialize, small_batches, table, tidy
from quillgrid.sources.scratch import scratch_path

SCALE = 256
#: Candidates searched at once, dimensions accumulated between two bounds, candidates that give first bounds, and bytes
#: of queries that are sent to every task.
ROW_BLOCK, DIMS, SEEDS, WAVE_BYTES = 8192, 8, 2048, 16 << 20
LARGEST = float(1 << 63)

QUERIES = "ids binary, n int, dim int, data binary, floors binary"
FOUND = "query_id long, vec_id long, score long"


def vectors_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floored vectors (dimension by row) of a batch (id, v); shorter vectors are filled with zeros."""
    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, dim = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False)), int(lengths.max(initial=0))
    data = np.zeros((len(lengths), dim), np.int64)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    data[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return batch.column(0).to_numpy(), np.ascontiguousarray(data.T)


def blocks_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            size += held[-1].num_rows
            if size >= rows:
                yield vectors_of(pa.concat_batches(held))
                held, size = [], 0
    if size:
        yield vectors_of(pa.concat_batches(held))


def sized(data: np.ndarray, dim: int) -> np.ndarray:
    """data with exactly dim dimensions."""
    return data[:dim] if len(data) >= dim else np.concatenate([data, np.zeros((dim - len(data), data.shape[1]), data.dtype)])


def number_kind(*data: np.ndarray) -> type:
    """The fastest kind in which sums of products and of squares are exact."""
    most = max(max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in data)
    bound = most * most * max(len(x) for x in data)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Best:
    """The k best candidates of one query, best first."""

    def __init__(self, own: int, k: int, floor: float):
        self.own, self.k, self.floor = own, k, floor
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = (ids != self.own) & (scores >= self.floor)
        ids, scores = ids[fits], scores[fits]
        if not len(ids):
            return
        if len(ids) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores.astype(object if scores.dtype == object else np.int64)])
        order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])))
        self.ids, self.scores = ids[order[: self.k]], scores[order[: self.k]]
        if len(self.ids) == self.k:
            self.floor = max(self.floor, self.scores[-1])


def search_block(q: np.ndarray, order: np.ndarray, rest: np.ndarray, c: np.ndarray, mass: np.ndarray, floor: float, dims: int = DIMS) -> tuple[np.ndarray | None, np.ndarray, int]:
    """(candidates that may reach floor, all if None; their products with q; component products made).

    order has q's dimensions by size, rest its norm from each place of that order on; c is dimension by row with the
    squared norms mass. Numbers must be of a kind in which their sums are exact.
    """
    alive, score, left, made = None, np.zeros(c.shape[1], c.dtype), mass, 0
    for at in range(0, len(order), dims):
        some = order[at : at + dims]
        part = c[some] if alive is None else c[some[:, None], alive]
        score = score + q[some] @ part
        made += part.size
        if at + dims >= len(order) or floor == -np.inf:
            continue
        left = left - np.einsum("ij,ij->j", part, part)
        bound = score + rest[at + dims] * np.sqrt(left)
        useful = bound * (1 + np.sign(bound) * 1e-5) + 1 >= floor
        if np.count_nonzero(useful) < 0.9 * len(useful):
            alive = np.flatnonzero(useful) if alive is None else alive[useful]
            score, left = score[useful], left[useful]
            if not len(alive):
                break
    return alive, score, made


class Wave:
    """Queries that are searched together."""

    def __init__(self, rows: list[Row], k: int):
        self.ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        self.floors = np.concatenate([np.frombuffer(r["floors"]) for r in rows])
        dim = max(r["dim"] for r in rows)
        self.data = np.concatenate([sized(np.frombuffer(r["data"], np.int64).reshape(r["dim"], r["n"]), dim) for r in rows], 1)
        self.k = k

    def search(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[Best], int, int]:
        """Each query's best, the component products made and those of a search without bounds."""
        best = [Best(i, self.k, f) for i, f in zip(self.ids.tolist(), self.floors.tolist(), strict=True)]
        q, dim = self.data.T, len(self.data)
        order = np.argsort(-np.abs(q), axis=1, kind="stable")
        squares = np.take_along_axis(q.astype(np.float64) ** 2, order, 1)[:, ::-1]
        rest = np.sqrt(np.concatenate([np.cumsum(squares, 1)[:, ::-1], np.zeros((len(q), 1))], 1))
        made = whole = 0
        for ids, c in blocks:
            c = sized(c, dim)
            kind = number_kind(q.T, c) if dim else np.float64
            asked, c = q.astype(kind), c.astype(kind)
            mass = np.einsum("ij,ij->j", c, c) if kind is not object else None
            for i, own in enumerate(best):
                if kind is object:  # beyond exact floating point: products in whole numbers, without bounds
                    alive, score, n = None, asked[i] @ c, c.size
                else:
                    alive, score, n = search_block(asked[i], order[i], rest[i], c, mass, own.floor)
                made, whole = made + n, whole + c.size
                own.add(ids if alive is None else ids[alive], score)
        return best, made, whole


def _first_floors(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best among the seeds, a lower bound of its k-th best; -inf with fewer."""
    dim = min(len(q), len(seeds))
    if number_kind(q, seeds) is object or len(seed_ids) <= k or not dim:
        return np.full(len(ids), -np.inf)
    scores = q[:dim].T.astype(np.float64) @ seeds[:dim].astype(np.float64)
    scores[ids[:, None] == seed_ids[None]] = -np.inf
    return np.partition(scores, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]


def _packed(queries: DataFrame, seeds: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """Queries in blocks, with the bounds that they start with."""
    sent = queries.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q in blocks_of(batches, ROW_BLOCK):
            floors = _first_floors(ids, q, *sent.value, k)
            yield pa.RecordBatch.from_pylist([{"ids": ids.astype(np.int64).tobytes(), "n": len(ids), "dim": len(q), "data": q.tobytes(), "floors": floors.astype(np.float64).tobytes()}], pa.schema([("ids", pa.binary()), ("n", pa.int32()), ("dim", pa.int32()), ("data", pa.binary()), ("floors", pa.binary())]))

    return queries.mapInArrow(tidy(run), QUERIES)


def _waves(blocks: DataFrame, k: int) -> Iterator[Wave]:
    held, size = [], 0
    for r in blocks.toLocalIterator():
        held.append(r)
        size += len(r["data"])
        if size >= WAVE_BYTES:
            yield Wave(held, k)
            held, size = [], 0
    if held:
        yield Wave(held, k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", row_id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k largest integer inner products of each query."""
    spark = candidates.sparkSession
    small_batches(spark)

    def usable(df: DataFrame) -> DataFrame:
        plain = F.col(vector).cast("array<double>")
        x = F.transform(plain, lambda v: v * F.lit(float(scale)))
        good = F.col(row_id).isNotNull() & F.forall(plain, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
        fits = F.when(F.forall(x, lambda v: F.abs(v) < LARGEST), x).otherwise(F.raise_error(F.lit("a vector's component does not fit 64 bits")))
        return df.where(good).select(F.col(row_id).cast("long").alias("id"), fits.alias("v"))

    rows = usable(candidates)
    first = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SEEDS).toArrow().combine_chunks().to_batches()
    seeds = vectors_of(first[0]) if first else (np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    path = scratch_path(spark, "best")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for wave in _waves(materialize(_packed(asked, seeds, k), "queries"), k):
        _search(rows, wave).write.mode("append").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(rows: DataFrame, wave: Wave) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = sent.value.search(blocks_of(batches, ROW_BLOCK))[0]
        for some in (best[i : i + 1024] for i in range(0, len(best), 1024)):
            own = np.repeat([b.own for b in some], [len(b.ids) for b in some])
            scores = [x for b in some for x in b.scores.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.concatenate([b.ids for b in some]), pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(tidy(run), FOUND)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, r::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""
