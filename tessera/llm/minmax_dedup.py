"""Near-duplicate detection by min-max hashing over word shingles, with every link confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so PERMUTATIONS hash
evaluations fill 2 * PERMUTATIONS values. Bands of ROWS values propose candidates: at a similarity of 0.8 a pair is missed with a
probability of (1 - 0.8^4)^32 < 5e-8, at 0.85 of 6e-11.

Work grows with the number of different texts, not with the size of groups:
1. Documents with equal shingle sets form one class; only classes are banded.
2. In each bucket every class is compared with one hub, the class that shares most buckets with others. Confirmed links join
   classes to components.
3. Where a bucket still holds several components, the classes outside its largest component are compared with all classes of
   the bucket, in blocks of bounded size, by a product of incidence matrices. A block emits one link for each class and component
   it reaches, never its pairs. Nothing is capped.

Classes are known by the place of a row, not by an id, so rows that share an id but not their text are told apart; a component's id
is the smallest of its rows' ids. Null texts count as empty. A document without words has an empty set, links with nothing and is
kept. A document without id takes no part: it has no component and is kept. Repeated rows share id and component. Ties of hubs go
to the earlier place; which hub is asked changes the work, never the links. Ids may be of any ordered type. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import carried, components, cut, small_or_shuffled, text_of, type_of

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Classes and shingles of one side of a block.
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1_000_000
REMEMBERED = 100_000

_rng = np.random.default_rng(20240607)
_multipliers = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_offsets = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_weights = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_row_weights = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_shift = np.uint64(32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _shift)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _shift)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> _shift)


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. Words: runs of other than ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        return mixed_bits(np.uint64(len(h)) + (mixed_bits(h) * _weights[32 : 32 + len(h)]).sum(keepdims=True))
    n = len(h) - width + 1
    x = np.zeros(n, np.uint64)
    for i in range(width):
        x += h[i : i + n] * _weights[i]
    return np.unique(mixed_bits(x))


def band_keys(found: np.ndarray) -> np.ndarray:
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(found), 4096):
        y = (found[None, i : i + 4096] ^ _offsets[:, None]) * _multipliers[:, None]
        np.minimum(low, y.min(1), out=low)
        np.maximum(high, y.max(1), out=high)
    values = np.concatenate([low, high]).reshape(BANDS, ROWS)
    return mixed_bits((mixed_bits(values) * _row_weights).sum(1)).view(np.int64)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, width, hashes)
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*[c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], [*[x for x in batch.schema.names if x != "text"], "n", "set", "bands"])

    return sign


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t, width, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, pa.binary())], ["class", "hashes"])

    return sets


def _confirmer(part: int, whole: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(whole * both >= part * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    return confirm


def links_of_block(few: list[tuple[int, int, np.ndarray]], many: list[tuple[int, int, np.ndarray]], part: int, whole: int) -> list[tuple[int, int]]:
    """(class, component, hashes) of both sides -> links across components, one for each class of few and component of many."""
    shared = np.intersect1d(np.unique(np.concatenate([h for _, _, h in few])), np.unique(np.concatenate([h for _, _, h in many])), assume_unique=True)
    both = np.zeros((len(few), len(many)), np.float64)
    step = 8192
    for at in range(0, len(shared), step):
        words = shared[at : at + step]
        sides = []
        for side in (few, many):
            m = np.zeros((len(side), len(words)), np.float32)
            for i, (_, _, h) in enumerate(side):
                h = h[np.searchsorted(h, words[0]) : np.searchsorted(h, words[-1], "right")]
                where = np.minimum(np.searchsorted(words, h), len(words) - 1)
                m[i, where[words[where] == h]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    sizes = [np.array([len(h) for _, _, h in side]) for side in (few, many)]
    linked = whole * both >= part * (sizes[0][:, None] + sizes[1][None, :] - both)
    out = {}
    for i, j in np.argwhere(linked):
        if few[i][1] != many[j][1]:
            out.setdefault((few[i][0], many[j][1]), (few[i][0], many[j][0]))
    return list(out.values())


def _blocks(part: int, whole: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = [[(c, p, np.frombuffer(h, np.uint64)) for c, p, h in zip(x["class"], x["component"], x["hashes"], strict=True)] for x in (group[group["few"]], group[~group["few"]])]
        return pd.DataFrame(links_of_block(*sides, part, whole) if all(sides) else [], columns=["a", "b"]).astype("int64")

    return compare


def near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept, text_md5).

    Documents are linked if similarity[1] * intersection >= similarity[0] * union of their shingle sets.
    """
    part, whole = similarity
    if not 0 < part <= whole or part / whole < 0.7:
        raise ValueError("the bands are made for similarities from 0.7 to 1")
    ident = type_of(docs, id_column)
    plain = docs.select(F.col(f"`{id_column}`").alias("id"), text_of(text_column).alias("text"))
    plain = plain.withColumn("md5", F.unhex(F.md5("text")))
    placed = plain.select(F.monotonically_increasing_id().alias("place"), "id", "md5", "text")
    signed = cut(placed.mapInArrow(_signer(width), f"place long, id {ident}, md5 binary, n long, set binary, bands array<long>"), "signed")
    # Aggregates are written before they are joined, as Spark splits a hot bucket only where nothing but exchanges feed a join.
    classes = signed.where("id is not null and n > 0").groupBy("set").agg(F.min(F.struct("place", "id", "md5")).alias("head"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select("set", F.col("head.place").alias("class"), F.col("head.id").alias("head_id"), F.col("head.md5").alias("head_md5"), "id", "n", "bands"), "classes")
    banded = classes.select("class", "n", F.posexplode("bands").alias("band", "key"))
    # A bucket of one class proposes nothing.
    sizes = cut(banded.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    members = cut(banded.join(sizes, ["band", "key"]), "members")
    fame = members.groupBy("class").agg(F.sum("m").alias("fame"))
    famed = cut(members.join(fame, "class"), "famed")
    hubs = cut(famed.groupBy("band", "key").agg(F.max(F.struct("fame", (-F.col("class")).alias("first"), "n")).alias("hub")), "hubs")
    near_sizes = whole * F.least("n", "hub.n") >= part * F.greatest("n", "hub.n")
    pairs = cut(
        famed.join(hubs, ["band", "key"]).where(near_sizes).select("class", (-F.col("hub.first")).alias("hub_class")).where("class <> hub_class")
        .select(F.least("class", "hub_class").alias("a"), F.greatest("class", "hub_class").alias("b")).distinct(), "pairs",
    )
    asked = classes.select("class", F.col("head_id").alias("id"), F.col("head_md5").alias("md5")).join(members.select("class").distinct(), "class", "left_semi")
    asked = cut(asked, "asked")
    # The head's text; rows equal in id and text give the same set.
    sets = plain.join(small_or_shuffled(asked), ["id", "md5"]).select("class", "text").mapInArrow(_setter(width), "class long, hashes binary")
    sets = cut(sets.dropDuplicates(["class"]), "sets")
    side = lambda x: sets.select(F.col("class").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    links = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_confirmer(part, whole), "a long, b long"), "links")
    first = cut(components(links), "first")

    # What hubs leave open: buckets of several components.
    labelled = famed.where("m > 2").drop("fame").join(first.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = cut(labelled, "labelled")
    counts = labelled.groupBy("band", "key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    open_ = counts.groupBy("band", "key").agg(F.count("*").alias("several"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s"), F.max(F.struct("c", "component", "s")).alias("top")).where("several > 1")
    blocks = lambda c, s: F.ceil(F.greatest(F.col(c) / BLOCK_CLASSES, F.col(s) / BLOCK_SHINGLES)).cast("int")
    open_ = open_.select("band", "key", F.col("top.component").alias("top"), (F.col("all_c") - F.col("top.c")).alias("few_c"), (F.col("all_s") - F.col("top.s")).alias("few_s"), "all_c", "all_s").withColumn("few_n", blocks("few_c", "few_s")).withColumn("many_n", blocks("all_c", "all_s"))
    open_ = cut(open_, "open")
    inside = labelled.join(open_, ["band", "key"])
    few = inside.where("component <> top").select("band", "key", F.pmod(F.xxhash64("class"), F.col("few_n")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("many_n") - 1)).alias("j"), "class", "component", F.lit(True).alias("few"))
    many = inside.select("band", "key", F.explode(F.sequence(F.lit(0), F.col("few_n") - 1)).alias("i"), F.pmod(F.xxhash64("class"), F.col("many_n")).cast("int").alias("j"), "class", "component", F.lit(False).alias("few"))
    block = cut(few.unionByName(many), "blocks")
    # The same classes meet in several bands: of blocks with the same content one is compared.
    content = block.groupBy("band", "key", "i", "j").agg(F.sum(F.xxhash64("class", "few").cast("decimal(38,0)")).alias("content"), F.count("*").alias("rows"))
    once = content.groupBy("content", "rows").agg(F.min(F.struct("band", "key", "i", "j")).alias("x")).select("x.*")
    block = block.join(once, ["band", "key", "i", "j"], "left_semi").join(sets, "class").select("band", "key", "i", "j", "class", "component", "few", "hashes")
    more = cut(block.groupBy("band", "key", "i", "j").applyInPandas(_blocks(part, whole), "a long, b long"), "more")
    final = cut(components(links.unionByName(more)), "components")

    # Only classes of several: the others are their own component. Written first, as one component may hold any share of them.
    linked = cut(final.withColumnRenamed("node", "class").join(classes.select("class", "id", "set"), "class").drop("class"), "linked")
    least = cut(linked.groupBy("component").agg(F.min("id").alias("least")), "least")
    named = linked.join(small_or_shuffled(least), "component").select("set", "least")
    # Rows that share a set without any link beyond it have their class's smallest id.
    # Written, so that Spark can split the rows of a set that many share.
    named = cut(classes.select("set", "id").withColumnRenamed("id", "own").join(named, "set", "left").select("set", F.coalesce("least", "own").alias("least")), "named")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return signed.select("id", "md5", "n", "set").join(named, "set", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"), F.col("md5").alias("text_md5"),
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document of each component, with all its columns."""
    found = near_duplicates(docs, width, similarity, id_column, text_column)
    dropped = cut(found.where("not kept").select(F.col(f"`{id_column}`").alias("id"), "text_md5").distinct(), "dropped")
    rows = carried(docs).withColumn("id", F.col(f"row.`{id_column}`")).withColumn("text_md5", F.unhex(F.md5(F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit("")))))
    return rows.join(small_or_shuffled(dropped), ["id", "text_md5"], "left_anti").select("row.*")
