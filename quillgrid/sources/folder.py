"""Folders in any file system that Spark knows, with numbered parts that count once they are finished."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillgrid.session import plain_unions


class Folder:
    """A path in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        plain_unions(spark)
        self._hadoop = self._path(self.path)
        self._fs = self._hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _texts(self, found: Any) -> list[str]:
        """The paths of what was listed: a few calls to the JVM, however many there are."""
        jvm = self.spark._jvm
        paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)
        return jvm.scala.collection.mutable.ArraySeq.make(paths).mkString("\n").split("\n") if len(paths) else []

    def at(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._hadoop)

    def names(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[1] for p in self._texts(self._fs.listStatus(self._hadoop))) if self.exists() else []

    def delete(self) -> None:
        self._fs.delete(self._hadoop, True)

    def make(self) -> None:
        self._fs.mkdirs(self._hadoop)

    def size(self) -> int:
        """Bytes of all files below."""
        return self._fs.getContentSummary(self._hadoop).getLength() if self.exists() else 0

    def parts(self) -> list[dict[str, int]]:
        """The numbers in the names (n=1.seq=2 ...) of the finished folders below, by n."""
        plain = re.sub(r"([\\\[\]{}*?^])", r"\\\1", self.path)
        done = self._fs.globStatus(self._path(f"{plain}/n=*/_SUCCESS"))
        named = [p.rsplit("/", 2)[1] for p in self._texts(done)] if done else []
        return sorted(({k: int(v) for k, v in (x.split("=") for x in n.split("."))} | {"path": n} for n in named), key=lambda p: p["n"])

    def write(self, df: DataFrame, **numbers: int) -> str:
        """Write df as the finished folder of these numbers; what an unfinished job left under the same n goes first."""
        path = self._free(numbers)
        df.write.parquet(path)
        return path

    def take(self, path: str, **numbers: int) -> str:
        """Make a folder of files that a job has finished, in the same file system, the finished folder of these numbers.

        What an unfinished job left there has to be gone (``tidy``): nothing is listed here.
        """
        to = self._named(numbers)
        self.make()
        if not self._fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} could not be renamed to {to}")
        self._fs.create(self._path(f"{to}/_SUCCESS")).close()
        return to

    def put(self, text: str, file: str, **numbers: int) -> str:
        """Write one small file as the finished folder of these numbers, without a job."""
        to = self._free(numbers)
        for name, content in ((file, text), ("_SUCCESS", "")):
            out = self._fs.create(self._path(f"{to}/{name}"))
            out.write(bytearray(content.encode()))
            out.close()
        return to

    def _free(self, numbers: dict[str, int]) -> str:
        """The path of the folder of these numbers, cleared of what an unfinished job left."""
        for old in self.names():
            if old.startswith(f"n={numbers['n']}.") or old == f"n={numbers['n']}":
                self.at(old).delete()
        return self._named(numbers)

    def _named(self, numbers: dict[str, int]) -> str:
        return f"{self.path}/{'.'.join(f'{k}={v}' for k, v in numbers.items())}"

    def tidy(self, last: int) -> None:
        """Delete what unfinished jobs left after the last finished number."""
        for old in self.names():
            if old.startswith("n=") and int(old[2:].split(".")[0]) > last:
                self.at(old).delete()

    def changed(self) -> int:
        """When something was last made or deleted right below, in milliseconds; 0 if there is no folder or no such time."""
        return self._fs.getFileStatus(self._hadoop).getModificationTime() if self.exists() else 0
