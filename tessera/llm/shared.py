"""Helpers shared by the training-data operators: shared-folder tables, row carriers, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of values, with ROW_BYTES for each row, of a table that may be broadcast: some 40 MB as a hash relation.
BROADCAST_BYTES, ROW_BYTES = 12_000_000, 16

#: Rows that Python workers get at once: texts, token ids and shingle sets are wide.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: From so many edges on, a component step writes its aggregates before it joins them.
MANY_EDGES = 500_000

_local_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master without that setting gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        _local_dirs[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}" if local else f".tessera/{app}"
    return _local_dirs[app]


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows at once from now on, in results that are run later too."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS or int(spark.conf.get(BATCH)) <= 0:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and returns a scan of it.

    It cuts the lineage without depending on any one executor: a lost executor's part is read again from the folder.
    The table is deleted by discard(), by release(), or when the driver ends.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing will read again."""
    for df in tables:
        _written.remove((df.sparkSession, df._tessera_path))
        _delete(df.sparkSession, df._tessera_path)


def mark() -> int:
    return len(_written)


def release(since: int, *kept: DataFrame) -> None:
    """Deletes the tables that cut() wrote since a mark(), but for those kept; whatever was built on them must have been written."""
    stay = {df._tessera_path for df in kept}
    for spark, path in _written[since:]:
        if path not in stay:
            _written.remove((spark, path))
            _delete(spark, path)


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return


def carried(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns of df in one struct, so that an operator's own columns clash with none of them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def text_of(column: str = "text") -> F.Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def type_of(df: DataFrame, column: str) -> str:
    """A column's type as a schema string has it."""
    return df.select(F.col(f"`{column}`")).schema[0].dataType.simpleString()


def bytes_of(table: DataFrame) -> int:
    """Bytes of a written table's values, with ROW_BYTES for each row; nested values count as their JSON text."""
    flat = {"string", "binary"}
    wide = [F.octet_length(f"`{c}`") if t in flat else F.octet_length(F.to_json(F.struct(f"`{c}`"))) for c, t in table.dtypes if t in flat or t.startswith(("array", "map", "struct"))]
    each = sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(ROW_BYTES + 8 * (len(table.columns) - len(wide))).cast("long"))
    return table.agg(F.sum(each)).first()[0] or 0


def small_or_shuffled(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its measured bytes are within BROADCAST_BYTES; beyond it Spark shuffles."""
    return F.broadcast(table) if bytes_of(table) <= BROADCAST_BYTES else table


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps: each is one aggregation and one join on the node, so nothing is gathered
    in one task or on the driver; it ends when a step changes no edge, after O(log^2 n) steps. With many edges the aggregates
    are written first: Spark splits a hub's edges only where nothing but exchanges feed the join.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        many = before is not None and before[0] > MANY_EDGES or before is None and e.count() > MANY_EDGES
        kept = []

        def settled(df: DataFrame, name: str) -> DataFrame:
            if many:
                df = cut(df, name)
                kept.append(df)
            return df

        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settled(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = settled(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        kept.append(e)
        e = cut(small, "edges")
        discard(*kept)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else schema)
