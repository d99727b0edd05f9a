"""Folders as the file system of Spark sees them: looked at, marked and cleared from the driver, no data read."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder that Spark reaches, looked at by its own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path
        self._fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _of(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, at: str = "") -> bool:
        return self._fs.exists(self._of(self.path + at))

    def match(self, pattern: str) -> list[str]:
        """Paths below the folder, relative to it."""
        found = self._fs.globStatus(self._of(self.path + pattern)) or []
        depth = pattern.strip("/").count("/") + 1
        return ["/".join(str(x.getPath()).split("/")[-depth:]) for x in found]

    def mark(self, at: str) -> None:
        self._fs.create(self._of(self.path + at), True).close()

    def delete(self, at: str) -> None:
        self._fs.delete(self._of(self.path + at), True)

    def rename(self, at: str, to: str) -> bool:
        return self._fs.rename(self._of(self.path + at), self._of(self.path + to))
