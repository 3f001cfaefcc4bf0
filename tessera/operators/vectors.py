"""Vector search: exact cosine distance with scopes, floors and hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.errors import RequestShape

# Fixed values
DIMENSION, DISTANCE_FLOOR, DEFAULT_K, MAX_K, RETRIEVED = 768, 0.5, 10, 100, 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def clamp_k(k: int | None) -> int:
    return DEFAULT_K if not k or k < 1 else min(k, MAX_K)


def check_dimension(vector: list[float], dimension: int = DIMENSION) -> None:
    if len(vector) != dimension:
        raise RequestShape(f"{len(vector)} dimensions; {dimension} are wanted")


def nearest(vectors: DataFrame, query: list[float], k: int | None = None, floor: float | None = DISTANCE_FLOOR, id_column: str = "node_id", vector_column: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest within the floor, nearest first, ties by id."""
    distance = cosine_distance(F.col(vector_column), F.array(*[F.lit(float(x)) for x in query]))
    found = vectors.where(F.size(vector_column) == len(query)).select(id_column, distance.alias("distance"))
    if floor is not None:
        found = found.where(F.col("distance") <= floor)
    return found.orderBy("distance", id_column).limit(clamp_k(k))


def in_scope(vectors: DataFrame, goals: DataFrame, goal: str | None = None, dataset: str | None = None, visible: DataFrame | None = None) -> DataFrame:
    """Vectors of one goal, of one dataset's goals (or of no goal), or of any goal; visible: goals that a user may see, whatever the scope."""
    if goal is not None:
        vectors = vectors.where(F.col("goal_id") == goal)
    elif dataset is not None:
        own = goals.select("goal_id", "dataset_id").withColumn("known", F.lit(True))
        vectors = vectors.join(own, "goal_id", "left").where(F.col("goal_id").isNull() | (F.col("dataset_id") == dataset)).drop("dataset_id", "known")
    return vectors if visible is None else vectors.join(visible.select("goal_id"), "goal_id", "left_semi")


def hydrate(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with their nodes in rank order, without absent and stale ones. hits is a top-k list."""
    return nodes.where(~F.coalesce("stale", F.lit(False))).join(F.broadcast(hits), "node_id").orderBy("distance", "node_id")


def to_embed(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes without a vector, and those marked as pending."""
    missing = nodes.join(vectors.select("node_id"), "node_id", "left_anti")
    return missing.unionByName(nodes.where(F.coalesce("embedding_pending", F.lit(False)))).dropDuplicates(["node_id"])


def orphans(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits without a node; none if no hit is live, as then the nodes may just be unreachable."""
    live = hits.join(nodes.select("node_id"), "node_id", "left_semi").limit(1).select(F.lit(True).alias("some_live"))
    return hits.join(nodes.select("node_id"), "node_id", "left_anti").join(F.broadcast(live)).drop("some_live")


def retrieval_prior(distance: Column) -> Column:
    return 1 - distance / 2
