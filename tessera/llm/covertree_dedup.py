"""Embedding near-duplicates: exact threshold pairs by dual traversal of a distributed cover tree.

Unit vectors of one label (and dimension) form a tree: a node of more than BLOCK vectors is split among up to PIVOTS of its
vectors, each vector going to the nearest, until nodes are blocks of at most BLOCK. A node has a centre, a covering radius and a number
of vectors. The tree is traversed against itself level by level as a table of node pairs: a pair is pruned if its balls are farther
apart than their radii and the threshold allow, and settled if they are so near that every pair must link, by one credit of links for
each node; only the others go on to their children. Pairs of blocks that are left are shipped, and a cover tree of each block
(nested levels, radii halved) is traversed against the other's under the same two bounds. Leaves compare cosines in double
precision; cosines within 1e-12 of the threshold are summed again without rounding errors. A task holds two blocks, and emits link
counts and for each linked vector one edge to its component in the task, never all pairs.

Equal unit vectors form one class with a multiplicity first, so any number of copies costs one vector.
Null, empty, zero, null-holding and non-finite vectors and null labels link with nothing. Vectors of different dimension
are not compared. Repeated rows count as other vectors. A null id takes part; a component's id is its smallest non-null id, whatever
the ids' type. A vector at equal distance from two pivots goes to the first. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import BROADCAST_BYTES, bytes_of, components, cut, small_or_shuffled, type_of

BLOCK = 2048
LEAF = 128
#: Pivots that a node of more than BLOCK vectors is split among, and the levels after which what is left is split by hash.
PIVOTS, LEVELS = 64, 24
SLACK = 1e-6


def unit(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / math.sqrt(v @ v) + 0.0


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Node:
    """A centre, the rows below it, the largest distance from the centre to one of them, and children within half of it."""

    __slots__ = ("centre", "rows", "radius", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: int, from_centre: np.ndarray):
        self.centre, self.rows, self.radius = centre, rows, float(from_centre.max())
        self.children: list[Node] = []
        if len(rows) <= LEAF or self.radius < 1e-7:
            return
        left, near = np.arange(len(rows)), from_centre
        chosen, nearest, least = [centre], np.zeros(len(rows), np.int64), near.copy()
        while True:  # the centre stays a centre one level down; others are added until half the radius covers all
            left = left[least[left] > self.radius / 2]
            if not len(left):
                break
            if len(chosen) > len(rows) // 8:  # unclustered: a level of balls no smaller than their rows prunes nothing
                return
            new = rows[left[0]]
            d = distance(points[rows], points[new : new + 1])[:, 0]
            d[left[0]] = 0.0
            closer = d < least
            least[closer], nearest[closer] = d[closer], len(chosen)
            chosen.append(int(new))
        order = np.argsort(nearest, kind="stable")
        ends = np.searchsorted(nearest[order], np.arange(len(chosen) + 1))
        for k, c in enumerate(chosen):
            if (part := order[ends[k] : ends[k + 1]]).size:
                self.children.append(Node(points, rows[part], c, least[part]))


def cover_tree(points: np.ndarray) -> Node:
    return Node(points, np.arange(len(points)), 0, distance(points, points[:1])[:, 0])


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


class Pairs:
    """Link counts and components between the rows of two blocks, or within one."""

    def __init__(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cosine: float, same: bool):
        self.a, self.b, self.na, self.nb, self.cosine = a, b, na.astype(np.float64), nb.astype(np.float64), cosine
        self.reach = math.sqrt(2 - 2 * cosine)
        self.links_a, self.links_b = np.zeros(len(a)), np.zeros(len(b))
        #: Rows of b follow those of a unless they are the same. A label is the smallest row known to be reachable.
        self.offset = 0 if same else len(a)
        self.label = np.arange(len(a) + (0 if same else len(b)))

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows x[i] and y[i] are linked: their labels become one."""
        x, y = self.label[x], self.label[y]
        while len(x := x[other := x != y]):
            y = y[other]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(further := self.label[self.label], self.label):
                self.label = further
            x, y = self.label[x], self.label[y]

    def all_link(self, rows: np.ndarray, others: np.ndarray) -> None:
        self.links_a[rows] += self.nb[others].sum()
        self.links_b[others] += self.na[rows].sum()
        both = np.concatenate([rows, others + self.offset])
        self.unite(both, np.full(len(both), rows[0]))

    def compare(self, rows: np.ndarray, others: np.ndarray) -> None:
        c = self.a[rows] @ self.b[others].T
        linked = c >= self.cosine
        if len(close := np.argwhere(np.abs(c - self.cosine) < 1e-12)):
            for i, j in close:
                linked[i, j] = exact_cosine(self.a[rows[i]], self.b[others[j]]) >= self.cosine
        if not linked.any():
            return
        ones = linked.astype(np.float64)
        self.links_a[rows] += np.einsum("ij,j->i", ones, self.nb[others])
        self.links_b[others] += np.einsum("ij,i->j", ones, self.na[rows])
        left, right = self.label[rows], self.label[others + self.offset]
        # Links inside one component tell nothing new. Labels flow along the others until they stay.
        linked &= left[:, None] != right[None, :]
        while linked.any():
            i, j = linked.any(1).nonzero()[0], linked.any(0).nonzero()[0]
            some = linked[np.ix_(i, j)]
            self.unite(np.concatenate([rows[i], rows[i[some.argmax(0)]]]), np.concatenate([others[j[some.argmax(1)]], others[j]]) + self.offset)
            linked &= self.label[rows][:, None] != self.label[others + self.offset][None, :]

    def traverse(self, x: Node, y: Node) -> None:
        stack = [([x], [y])]
        while stack:
            left, right = stack.pop()
            d = distance(self.a[[n.centre for n in left]], self.b[[n.centre for n in right]])
            radii = np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])[None, :]
            open_ = d <= radii + self.reach + SLACK
            every = open_ & (d + radii <= self.reach - SLACK)
            for i, j in np.argwhere(open_):
                p, q = left[i], right[j]
                if every[i, j]:
                    self.all_link(p.rows, q.rows)
                elif not p.children and not q.children:
                    self.compare(p.rows, q.rows)
                else:
                    stack.append((p.children or [p], q.children or [q]))

    def edges(self) -> list[tuple[int, int]]:
        """Each row that is not its component's first, with that first."""
        return [(int(x), int(self.label[x])) for x in np.flatnonzero(self.label != np.arange(len(self.label)))]


def linked_pairs(a: np.ndarray, na: np.ndarray, b: np.ndarray | None, nb: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray | None, list[tuple[int, int]]]:
    """Links of each row of a (and of b), and edges that join each component; rows of b follow those of a. Without b: within a, where a row is not its own link."""
    tree = cover_tree(a)
    if b is None:
        found = Pairs(a, a, na, na, cosine, same=True)
        found.traverse(tree, tree)
        # every pair was met from both sides, and every row met itself
        return found.links_a.astype(np.int64) - na, None, found.edges()
    found = Pairs(a, b, na, nb, cosine, same=False)
    found.traverse(tree, cover_tree(b))
    return found.links_a.astype(np.int64), found.links_b.astype(np.int64), found.edges()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [None if label is None else unit(v) for label, v in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist(), strict=True)]
        data = [None if v is None else v.tobytes() for v in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([None if d is None else xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array([None if v is None else len(v) for v in found], pa.int32()), pa.array(data, pa.binary())], ["place", "id", "label", "key", "dim", "unit"])


def _nearest(shared):
    """Of a vector and its node's pivots (one after the other in shared, or else in the row): the nearest, and its distance."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, units = batch.column("node").to_pylist(), batch.column("unit").to_pylist()
            cells, far = np.zeros(len(nodes), np.int32), np.zeros(len(nodes))
            by: dict[str, list[int]] = {}
            for i, node in enumerate(nodes):
                by.setdefault(node, []).append(i)
            for node, at in by.items():
                points = np.frombuffer(b"".join(units[i] for i in at)).reshape(len(at), -1)
                pivots = shared.value[node] if shared else batch.column("pivots")[at[0]].as_py()
                c = points @ np.frombuffer(pivots).reshape(-1, points.shape[1]).T
                cells[at] = c.argmax(1)
                far[at] = np.sqrt(np.maximum(2 - 2 * c.max(1), 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("place", "n", "unit", "path")], pa.array(cells), pa.array(far)], ["place", "n", "unit", "path", "cell", "far"])

    return nearest


BLOCK_SCHEMA = "node string, places binary, counts binary, units binary"


def _pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("place")
    return pd.DataFrame([[*key, group["place"].to_numpy(np.int64).tobytes(), group["n"].to_numpy(np.int64).tobytes(), b"".join(group["unit"])]], columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


PAIR = "a string, b string, inner_a boolean, inner_b boolean, radius_a double, radius_b double, verdict int"


def _verdicts(cosine: float):
    """Of two nodes' balls: 0 no pair links, 2 every pair links, 1 neither is certain."""
    reach = math.sqrt(2 - 2 * cosine)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [0.0 if a == b else float(np.linalg.norm(np.frombuffer(x) - np.frombuffer(y))) for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "centre_a", "centre_b")), strict=True)]
            d, radii = np.array(apart), batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            verdict = np.where(d > radii + reach + SLACK, 0, np.where(d + radii <= reach - SLACK, 2, 1)).astype(np.int32)
            kept = [c.split()[0] for c in PAIR.split(", ")][:-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(verdict, pa.int32())], [*kept, "verdict"])

    return judge


def _compare(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                pa_, pb = np.frombuffer(r["places_a"], np.int64), np.frombuffer(r["places_b"], np.int64)
                na, nb = np.frombuffer(r["counts_a"], np.int64), np.frombuffer(r["counts_b"], np.int64)
                a, b = np.frombuffer(r["units_a"]).reshape(len(pa_), -1), np.frombuffer(r["units_b"]).reshape(len(pb), -1)
                la, lb, edges = linked_pairs(a, na, None if same else b, None if same else nb, cosine)
                place = pa_ if same else np.concatenate([pa_, pb])
                rows = [(int(p), None, int(n)) for p, n in zip(place, la if lb is None else np.concatenate([la, lb]), strict=True) if n]
                rows += [(int(place[i]), int(place[j]), 0) for i, j in edges]
                x, y, n = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return compare


VECTOR = "place long, n long, unit binary, path array<string>"


def grown(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree: vectors (place, n, unit, path), path being the nodes that a vector is in from the root on, and nodes.

    nodes: (node, parent, inner, centre, radius, weight, first): whether it has children, the number of its rows, one vector's place.
    """
    spark = classes.sparkSession
    root = F.concat(F.col("dim").cast("string"), F.lit(":"), F.hex(F.encode("label", "UTF-8")))
    vectors = cut(classes.select("place", "n", "unit", F.array(root).alias("path")), "vectors")
    here = F.element_at("path", -1)
    stats = (F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("place").alias("first"))
    columns = ["node", "parent", (F.col("size") > BLOCK).alias("inner"), "centre", "radius", "size", "weight", "first"]
    # The root's ball is the whole sphere.
    tops = vectors.groupBy(here.alias("node")).agg(*stats, F.min("unit").alias("centre"))
    nodes = cut(tops.withColumn("parent", F.lit(None).cast("string")).withColumn("radius", F.lit(2.0)).select(*columns), "nodes")
    level, done, made = 0, [], [nodes]
    while True:
        large = cut(nodes.where("inner").select("node", F.col("size").alias("in_size")), "large")
        if not large.count():
            done.append(vectors)
            break
        in_large = small_or_shuffled(large)
        at_node = vectors.withColumn("node", here)
        done.append(at_node.join(in_large, "node", "left_anti").drop("node"))
        inside = cut(at_node.join(in_large, "node"), "inside")
        level += 1
        cells = F.greatest(F.lit(2), F.ceil(2 * F.col("in_size") / BLOCK)).cast("int")
        if level <= LEVELS:
            # As pivots serve the vectors of smallest hash; more than are wanted are expected to be drawn.
            wanted, hashed = F.least(F.lit(PIVOTS), cells), F.xxhash64("place", F.lit(level))
            drawn = inside.where(F.shiftrightunsigned(hashed, 1) < (2 * wanted + 32) / F.col("in_size") * float(1 << 63))
            drawn = drawn.groupBy("node").agg(F.max(wanted).alias("k"), F.array_sort(F.collect_list(F.struct(hashed.alias("h"), "unit"))).alias("u"))
            pivots = cut(drawn.select("node", F.expr("aggregate(transform(slice(u, 1, k), x -> x.unit), cast('' as binary), (a, x) -> concat(a, x))").alias("pivots")), "pivots")
            if bytes_of(pivots) <= BROADCAST_BYTES:
                shared = spark.sparkContext.broadcast({r.node: bytes(r.pivots) for r in pivots.collect()})
                met_by = inside
            else:
                shared, met_by = None, inside.join(pivots, "node")
            dealt = met_by.mapInArrow(_nearest(shared), f"{VECTOR}, cell int, far double")
        else:
            dealt = inside.select("place", "n", "unit", "path", F.pmod(F.xxhash64("place", F.lit(level)), cells).cast("int").alias("cell"), F.lit(2.0).alias("far"))
        vectors = cut(dealt.select("place", "n", "unit", F.concat("path", F.array(F.concat_ws("/", here, F.col("cell").cast("string")))).alias("path"), "far"), "vectors")
        # The centre is the vector nearest to the pivot, which is the pivot itself but for rounding.
        own = vectors.groupBy(here.alias("node"), F.element_at("path", -2).alias("parent")).agg(*stats, F.min(F.struct("far", "place", "unit")).alias("mid"), F.max("far").alias("far"))
        radius = F.least(F.col("far") + F.col("mid.far"), F.lit(2.0)).alias("radius")
        nodes = cut(own.select("node", "parent", F.col("mid.unit").alias("centre"), radius, "size", "weight", "first").select(*columns), "nodes")
        made.append(nodes)
        vectors = vectors.drop("far")
    return reduce(DataFrame.unionByName, done), cut(reduce(DataFrame.unionByName, made).drop("size"), "tree")


def met(tree: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of blocks to be compared, pairs of nodes of which every pair links): rows (a, b), each unordered pair once."""
    ball = [F.col(c) for c in ("centre", "radius", "inner")]
    # From a node one goes on to its children.
    steps = tree.where("parent is not null").select(F.col("parent").alias("from"), F.col("node").alias("to"), *ball)
    named = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns])
    tops = named(tree.where("parent is null").select("node", *ball), "a").withColumnRenamed("node_a", "a")
    pairs = tops.select("*", F.col("a").alias("b"), *[F.col(f"{c}_a").alias(f"{c}_b") for c in ("centre", "radius", "inner")])
    blocks, settled = [], []
    while True:
        judged = cut(pairs.mapInArrow(_verdicts(cosine), PAIR).where("verdict > 0"), "judged")
        settled.append(judged.where("verdict = 2").select("a", "b"))
        blocks.append(judged.where("verdict = 1 and not inner_a and not inner_b").select("a", "b"))
        further = judged.where("verdict = 1 and (inner_a or inner_b)")
        if not further.count():
            break
        # A node with itself: its children with each other. Else the larger of the nodes that have children makes way for them.
        same = further.where("a = b").select("a").join(named(steps, "a"), F.col("a") == F.col("from_a")).join(named(steps, "b"), F.col("a") == F.col("from_b")).where("to_a <= to_b")
        other = further.where("a <> b").withColumn("first", F.expr("inner_a and (not inner_b or radius_a >= radius_b)"))
        kept = named(tree.select("node", *ball), "k")
        one = other.select(F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("open"), F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("stay"))
        one = one.join(named(steps, "a"), F.col("open") == F.col("from_a")).join(kept, F.col("stay") == F.col("node_k"))
        out = ["to_a", "centre_a", "radius_a", "inner_a"]
        pairs = same.select(*out, "to_b", "centre_b", "radius_b", "inner_b").unionByName(one.select(*out, F.col("node_k").alias("to_b"), *[F.col(f"{c}_k").alias(f"{c}_b") for c in ("centre", "radius", "inner")]))
        pairs = pairs.withColumnsRenamed({"to_a": "a", "to_b": "b"})
    return cut(reduce(DataFrame.unionByName, blocks), "block-pairs"), cut(reduce(DataFrame.unionByName, settled), "settled")


def credited(vectors: DataFrame, tree: DataFrame, settled: DataFrame) -> DataFrame:
    """(a, b, n) of node pairs of which every pair links: links of each vector, an edge to one vector that it links with, and an edge for each pair."""
    sides = settled.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(settled.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("other")))
    sides = cut(sides.join(tree.select(F.col("node").alias("other"), "weight", "first"), "other"), "sides")
    by_node = cut(sides.groupBy("node").agg(F.sum("weight").alias("credit"), F.min("first").alias("first"), F.max((F.col("node") == F.col("other")).cast("int")).alias("own")), "credits")
    each = cut(vectors.select("place", "n", F.explode("path").alias("node")).join(small_or_shuffled(by_node), "node"), "credited")
    links = each.select(F.col("place").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("credit") - F.col("own") * F.col("n")).alias("n"))
    edges = each.select(F.col("place").alias("a"), F.col("first").alias("b"), F.lit(0).cast("long").alias("n"))
    across = sides.withColumnRenamed("first", "b").join(tree.select("node", F.col("first").alias("a")), "node").select("a", "b", F.lit(0).cast("long").alias("n"))
    return links.unionByName(edges).unionByName(across)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of vectors."""
    spark, ident = vectors.sparkSession, type_of(vectors, id_column)
    source = vectors.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("string").alias("label"), F.col(f"`{vector_column}`").alias("vector"))
    rows = cut(source.mapInArrow(_units, f"place long, id {ident}, label string, key binary, dim int, unit binary"), "units")
    usable = rows.where("key is not null")
    # unit is the same for all rows of a class
    classes = cut(usable.groupBy("label", "dim", "key").agg(F.min("place").alias("place"), F.min("id").alias("id"), F.count("*").alias("n"), F.first("unit").alias("unit")), "classes")
    dealt, tree = grown(classes)
    pairs, settled = met(tree, cosine)
    blocks = cut(dealt.select(F.element_at("path", -1).alias("node"), "place", "n", "unit").groupBy("node").applyInPandas(_pack, BLOCK_SCHEMA), "blocks")
    side = lambda x: blocks.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("places", "counts", "units")])
    shipped = pairs.join(side("a"), "a").join(side("b"), "b")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(shipped.repartition(tasks, "a", "b").mapInArrow(_compare(cosine), "a long, b long, n long"), "links")
    if settled.count():
        found = found.unionByName(credited(dealt, tree, settled))

    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    parts_of = components(found.where("b is not null").select("a", "b"))
    named = classes.select("label", "dim", "key", "place", "id", "n").join(links.withColumnRenamed("a", "place"), "place", "left").join(parts_of.withColumnRenamed("node", "place"), "place", "left")
    # Written before they are joined, as one component may hold any share of the classes.
    named = cut(named.withColumn("component", F.coalesce("component", "place")), "named")
    least = cut(named.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    named = cut(named.join(least, "component").select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"), "named")
    out = rows.select("id", "label", "dim", "key").join(named, ["label", "dim", "key"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))
