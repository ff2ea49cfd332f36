"""Where tables between steps are written: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; only local sessions without one get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="quillgrid-")
    spark.sparkContext.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quillgrid-{name}-{uuid.uuid4().hex}"
