"""Small files through Hadoop's FileSystem, so that any store Spark reads works."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def size(self, folder: str) -> int:
        p = self.path(folder)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes beside, under a name of its own, and renames without overwriting; False if ``name`` is there already or another writer won."""
        target = self.path(name)
        if self._fs.exists(target):
            return False
        beside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        fs = self._jvm.org.apache.hadoop.fs
        plain = getattr(fs, "Options$Rename").NONE
        some = self._jvm.java.lang.reflect.Array.newInstance(plain.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(some, 0, plain)
        try:
            fs.FileContext.getFileContext(beside.toUri(), self._conf).rename(beside, target, some)
        except Py4JJavaError:
            self._fs.delete(beside, False)
            return False
        return self.read(name) == text

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
