"""Small files of metadata on any file system that Spark's Hadoop client reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidemark.errors import MetadataError


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def _at(self, *names: str):  # noqa: ANN202 - JVM objects
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(*names))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, *names: str) -> bool:
        path, fs = self._at(*names)
        return bool(fs.exists(path))

    def read_text(self, *names: str) -> str:
        path, fs = self._at(*names)
        if not fs.exists(path):
            raise MetadataError(f"no such file: {path}")
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, text: str, *names: str) -> None:
        path, fs = self._at(*names)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_text(self, text: str, *names: str, replace: bool = False) -> bool:
        """Write a file that is seen whole or not at all; without ``replace`` only if there is none: whether it was written."""
        jvm, part = self.spark._jvm, (*names[:-1], f"_tmp_{uuid.uuid4().hex}")
        self.write_text(text, *part)
        (a, fs), (b, _) = self._at(*part), self._at(*names)
        options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE if replace else options.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(a).toUri(), self.spark._jsc.hadoopConfiguration()).rename(a, b, how)
            return True
        except Exception:
            fs.delete(a, False)
            if replace or not fs.exists(b):
                raise
            return False

    def names(self, *names: str) -> list[str]:
        path, fs = self._at(*names)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        (a, fs), (b, _) = self._at(*source), self._at(*target)
        if fs.exists(b):
            fs.delete(b, True)
        if not fs.rename(a, b):
            raise MetadataError(f"can't move {a} to {b}")

    def remove(self, *names: str) -> None:
        path, fs = self._at(*names)
        fs.delete(path, True)
