"""Helpers shared by the operators: scratch tables in the shared folder, Arrow batch limits, table loading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.session import plain_unions
from quillgrid.sources.scratch import scratch_path

#: The one definition of a word: a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch sent to Python; a batch has one row at least.
BATCH_BYTES = "1m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, unless it has a bound, so that long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    plain_unions(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """df as a side of a sort-merge join, for tables that grow with the input.

    Spark broadcasts what is below its limit when compressed. In memory that is several times as much, and a plan with
    dozens of such joins holds it all on the driver at once.
    """
    return df.hint("merge")


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/quillgrid-" in f}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that gives its memory back to the system at the end: workers live on and wait."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def shuffle_width(spark: SparkSession, least: int = 64) -> int:
    """A number of buckets that follows the session's shuffle width, so that it grows with the cluster."""
    return max(least, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of ``taken`` (case doesn't count)."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df with the columns that are called like one of ``names`` renamed: underscores are put after their names.

    Operators give their own columns the names that they document; a caller's column of that name stays, renamed.
    """
    lower = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in lower]
    return df.withColumnsRenamed(dict(zip(clash, fresh([*df.columns, *names], *clash), strict=True))) if clash else df


def utf8(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text, F.lit(""))
