"""Exact deduplication: groups by a 128-bit content hash, compares bytes inside groups, keeps one row of each.

DataFrame functions only. Only (hash, id) rows are shuffled for all documents; texts are shuffled only for rows whose hash
occurs more than once, and a large group's texts are compared with one head text, never with each other.

Null texts count as empty, so null and empty texts form one group. A null id orders behind every other id. Rows repeated with
the same id are told apart by their place in the scan, so exactly one row of a group is kept; ties of id go to the first place, or to
the last if the largest stays. Extra columns pass through `without_copies` and are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import carried, cut, small_or_shuffled, text_of


def _placed(docs: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    """Rows (place, id, hash, sha, ...): a hash's copies are compared by text later; the hash alone decides nothing."""
    text = F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit(""))
    own = [F.monotonically_increasing_id().alias("place"), F.col(f"row.`{id_column}`").alias("id"), F.unhex(F.md5(text)).alias("hash"), F.sha2(text, 256).alias("sha")]
    return cut(carried(docs).select(*own, *more), "hashes")


def groups_of_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays.
    """
    return _grouped(_placed(docs, id_column, text_column), docs, id_column, text_column, keep).drop("place")


def _grouped(rows: DataFrame, docs: DataFrame, id_column: str, text_column: str, keep: str) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = text_of(text_column)
    ident = F.col(f"`{id_column}`")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "place") if keep == "smallest" else F.struct(F.col("id").isNotNull().alias("some"), "id", "place")
    best = (F.min if keep == "smallest" else F.max)(order).alias("best")

    def grouped(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), best).where("n > 1").select(*keys, "n", F.col("best.id").alias("keep_id"), F.col("best.place").alias("keep_place"))

    found = cut(grouped(rows, "hash"), "groups")
    copies = cut(
        docs.select(F.unhex(F.md5(text)).alias("hash"), ident.alias("id"), text.alias("text"))
        .join(found.select("hash", "keep_id"), "hash").select("hash", "text", F.col("id").eqNullSafe(F.col("keep_id")).alias("head")), "copies",
    )
    # Written before the join, as Spark splits a hot hash only where nothing but exchanges feed it.
    heads = cut(copies.where("head").groupBy("hash").agg(F.min("text").alias("head_text")), "heads")
    differing = cut(copies.join(heads, "hash").where("text <> head_text").select("hash"), "differing")
    collided = differing.distinct()
    # Hashes that two texts share are grouped again, by both hashes; there should be none.
    apart = grouped(rows.join(collided, "hash", "left_semi"), "hash", "sha").select("hash", "sha", *[F.col(c).alias(f"{c}_2") for c in ("n", "keep_id", "keep_place")])
    out = (
        rows.join(found, "hash", "left")
        .join(collided.withColumn("split", F.lit(True)), "hash", "left")
        .join(apart, ["hash", "sha"], "left")
    )
    pick = lambda c, alone: F.coalesce(F.when(F.col("split"), F.col(f"{c}_2")).otherwise(F.col(c)), alone)
    single = F.when(F.col("split"), F.col("n_2")).otherwise(F.col("n")).isNull()
    return out.select(
        "place",
        F.col("id").alias(id_column),
        F.when(single, F.col("id")).otherwise(F.when(F.col("split"), F.col("keep_id_2")).otherwise(F.col("keep_id"))).alias("keep_id"),
        pick("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("place") == pick("keep_place", F.col("place"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without exact copies: of each group of equal texts one row stays, with all its columns.

    Only the places of dropped rows are joined, so texts are not shuffled as long as those are few enough to be broadcast.
    """
    rows = _placed(docs, id_column, text_column, F.col("row"))
    dropped = cut(_grouped(rows.drop("row"), docs, id_column, text_column, keep).where("not kept").select("place"), "dropped")
    return rows.join(small_or_shuffled(dropped), "place", "left_anti").select("row.*")
