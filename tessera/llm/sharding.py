"""Sharding: contiguous shards of nearly equal bytes, cut on global prefix sums of sizes.

Rows are ordered by the smallest id of their group of equal texts, so a group lies together, and else by id. A range exchange
orders them globally; each partition's total is summed, totals become partition offsets, and an offset plus the running sum
inside the partition is a row's global byte position. A row, or a group of equal texts as a whole, goes to the one of equal byte
intervals in which its middle lies, so shards are contiguous in that order and differ by less than the largest unit.

A group stays in one shard as long as its bytes are at most GROUP_SHARE of a shard's equal share. A larger group would tilt the
shards (one may hold a third of all rows), so it is laid out row by row over as many neighbouring shards as it fills.

A null text has no bytes and equals an empty one; every row still weighs one. A null id orders first. Ties, rows equal in id and
text, follow their place in the scan; they differ in nothing but their slot. Repeated rows are spread over range partitions,
so one id or text may hold any share of the rows. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, small_or_shuffled, text_of

#: Of a shard's equal share of bytes: the most that a group of equal texts may have and stay whole.
GROUP_SHARE = 0.05


def balanced_shards(docs: DataFrame, shards: int = 16, group_share: float = GROUP_SHARE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot), slot being the row's place in its shard, from 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = text_of(text_column)
    sized = docs.select(
        F.col(f"`{id_column}`").alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text)).alias("hash"), F.monotonically_increasing_id().alias("salt"),
    )
    sized = cut(sized, "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    # Written before the join, as Spark splits a hot text only where nothing but exchanges feed it.
    groups = cut(sized.groupBy("hash").agg(F.min("id").alias("lead"), F.sum("size").alias("together"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    whole = F.col("together") <= group_share * total / shards
    led = sized.join(small_or_shuffled(groups), "hash", "left").select(
        F.when(F.col("together").isNull(), F.col("id")).otherwise(F.col("lead")).alias("lead"), F.coalesce(whole, F.lit(False)).alias("whole"), "hash", "id", "salt", "size", "crc",
    )
    # A whole group's rows are equal in what deals them out, so one partition gets them all; others are spread.
    spread = F.when(~F.col("whole"), F.col("id")), F.when(~F.col("whole"), F.col("salt"))
    dealt = led.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "lead", "hash", *spread)
    ordered = cut(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    # One row for each partition: as many as spark.sql.shuffle.partitions.
    behind = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(behind), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(behind), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("part").orderBy("lead", "hash", "id", "salt")
    to_here = inside.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bytes_before") + F.coalesce(F.sum("size").over(to_here), F.lit(0))
    placed = ordered.join(F.broadcast(offsets), "part").select(
        "id", "size", "crc", "part", "hash", "lead", "whole", start.alias("start"), (F.col("rows_before") + F.row_number().over(inside) - 1).alias("at")
    )
    group = Window.partitionBy("part", "lead", "hash", F.when(~F.col("whole"), F.col("at")))
    middle = F.when(F.col("whole"), 2 * F.min("start").over(group) + F.sum("size").over(group)).otherwise(2 * F.col("start") + F.col("size"))
    placed = placed.withColumn("middle", middle).withColumn("shard", F.expr(f"cast((middle * {int(shards)}) div (2 * {max(total, 1)}L) as int)"))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"))
