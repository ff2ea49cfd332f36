"""A Spark session with the defaults that the library counts on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.unionOutputPartitioning": "false",
}


def plain_unions(spark: SparkSession) -> None:
    """Unions of parts that are dealt by the same key do not count as dealt by it, in sessions of any maker.

    Spark 4.1 takes them so and drops the shuffle that follows; adaptive execution then coalesces each part's shuffle by
    its own sizes. Rows of one key would stay in several tasks, which gives wrong rows, or the job fails.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def apart(df: DataFrame, key: str = "id") -> DataFrame:
    """df, for one part of a union, with a text key of which Spark does not know how it is dealt.

    What ``plain_unions`` asks for then holds in the plan itself, whatever the session says when it runs.
    """
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """getOrCreate with DEFAULTS; further settings by keyword, with "__" for "."."""
    builder = SparkSession.builder.appName("quillgrid")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
