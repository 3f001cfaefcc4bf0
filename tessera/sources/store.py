"""Objects of any file system that Hadoop reaches: put, get, list, delete, and a size cap on what is staged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tessera.plans.errors import RequestShape

#: Largest source object that is read, in bytes.
MAX_OBJECT = 512 * 2**20


def scratch(spark: SparkSession) -> str:
    """The name of a new folder that all executors see: below spark.checkpoint.dir, or below the default file system's home where that
    is unset; only a local master gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='tessera-')}" if spark.sparkContext.master.startswith("local[") else ".tessera"
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def put(self, key: str, data: bytes) -> str:
        out = self.fs.create(self._path(key), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return f"{self.root}/{key}"

    def get(self, key: str, most: int = MAX_OBJECT) -> bytes:
        self.check_size(key, most)
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def keys(self) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        found, it = [], self.fs.listFiles(self._path(""), True)
        base = self.fs.makeQualified(self._path("")).toString()
        while it.hasNext():
            found.append(it.next().getPath().toString().removeprefix(base).lstrip("/"))
        return sorted(found)

    def wipe(self) -> None:
        self.fs.delete(self._path(""), True)

    def check_size(self, key: str, most: int = MAX_OBJECT) -> int:
        size = self.fs.getContentSummary(self._path(key)).getLength()
        if size > most:
            raise RequestShape(f"{key} has {size} bytes; {most} are allowed")
        return size
