"""Tabular sources: scans by file suffix, the Parquet sink, staging, and the scoping of references."""

from __future__ import annotations

import hashlib
import threading
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.plans.errors import UnsupportedFormat


def suffix(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header (types inferred unless a schema is given, empty fields null) or Parquet."""
    match suffix(path):
        case "csv":
            reader = spark.read.option("header", True).option("nullValue", "")
            return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        case "parquet":
            return spark.read.parquet(path)
        case other:
            raise UnsupportedFormat(f"{path}: .{other}")


def to_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def fingerprint(spark: SparkSession, path: str) -> str:
    """What a source holds, by the names, sizes and times of its files: the same path with new files is another source."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


class _Kept:
    def __init__(self):
        self.filled, self.users, self.df, self.error = threading.Event(), 0, None, None


class Stage:
    """Sources read once and kept in executor memory and disk, known by what their files hold.

    Threads that ask for the same source at once wait for one fill. A source in use is never let go; beyond capacity the least
    recently used of the others is. A fill that fails is told to all who wait and is not kept.
    """

    def __init__(self, spark: SparkSession, capacity: int = 8):
        self.spark, self.capacity, self.lock = spark, capacity, threading.Lock()
        self.kept: OrderedDict[str, _Kept] = OrderedDict()

    @contextmanager
    def use(self, path: str) -> Iterator[DataFrame]:
        key = fingerprint(self.spark, path)
        with self.lock:
            fills = key not in self.kept
            own = self.kept.setdefault(key, _Kept())
            own.users += 1
            self.kept.move_to_end(key)
        try:
            if fills:
                try:
                    own.df = scan(self.spark, path).persist(StorageLevel.MEMORY_AND_DISK)
                except Exception as error:
                    own.error = error
                    with self.lock:
                        del self.kept[key]
                    raise
                finally:
                    own.filled.set()
            own.filled.wait()
            if own.df is None:
                raise own.error
            yield own.df
        finally:
            with self.lock:
                own.users -= 1
                idle = [k for k, x in self.kept.items() if not x.users and x.filled.is_set()]
                for k in idle[: max(0, len(self.kept) - self.capacity)]:
                    self.kept.pop(k).df.unpersist()


def registered(requests: DataFrame, registry: DataFrame, ref: str = "ref") -> DataFrame:
    """Requests whose reference is registered."""
    return requests.join(registry.select(ref).distinct(), ref, "left_semi")


def pages(documents: DataFrame, id_column: str, text_column: str, separator: str = "\n") -> DataFrame:
    """Documents as ordered pages (id, page_idx, text)."""
    return documents.select(F.col(id_column), F.posexplode(F.split(F.col(text_column), separator)).alias("page_idx", "text"))


def document_sample(documents: DataFrame, text_column: str, characters: int = 4000) -> DataFrame:
    return documents.withColumn("sample", F.substring(F.col(text_column), 1, characters))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_idx, text) of PDF files. A bad page fails the read."""

    def read(batches):
        from tessera.sources.pdf import page_texts

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                texts = list(page_texts(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], ["path", "page_idx", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, page_idx int, text string")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has, as a part of the plan: through Arrow, so no Python worker starts for them."""
    kind = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(kind), strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=to_arrow_schema(kind)), kind)
