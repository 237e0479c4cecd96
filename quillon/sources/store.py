"""Small files and folders on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if there is none."""
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file, whole or not at all, unless there is one already; whether it was written.

        The text goes into a file of another name, which is then renamed without replacing anything. File systems with
        an atomic rename (HDFS) let one of several writers win.
        """
        fs, p = self._at(path)
        _, new = self._at(f"{path}.{uuid.uuid4().hex}.new")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
            context.rename(new, p, self.spark.sparkContext._gateway.new_array(kind, 0))
            return True
        except Py4JJavaError:
            fs.delete(new, False)
            if fs.exists(p):
                return False
            raise

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def delete_at_exit(self, path: str = "") -> None:
        """The folder goes when the driver's JVM ends."""
        fs, p = self._at(path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
