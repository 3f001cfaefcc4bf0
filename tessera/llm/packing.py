"""Packing documents into token sequences by cutting-stock column generation.

Every document becomes its token ids and an end id, cut into pieces of CAPACITY and one remainder. The histogram of piece
lengths, in classes of UNIT tokens, is a cutting-stock problem of fixed size: a linear program over patterns (how many pieces
of each class fill a sequence), whose columns come from a knapsack dynamic program priced by the duals. Rounded patterns
are then filled with the pieces of each class in rank order, longest first. What the rounded patterns leave over is laid end
to end and cut at each CAPACITY, so only its last sequence is short.

The driver sees the histogram and the patterns only. Ranks and positions are prefix sums of bucket totals, so a length that
a third of all documents share is still spread over tasks.

Null texts count as empty; an empty document is its end id. Repeated rows are packed each on its own; ties of length follow their
place in the scan. The string of an added token inside a text becomes that token's id, as the tokenizer does once it is loaded.
Ids of any type, null ones too, are carried through; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, type_of

CAPACITY = 2048
UNIT = 8
CLASSES = CAPACITY // UNIT
END_ID = 1
#: The linear program ends when its value is within this share of Farley's lower bound.
GAP = 2e-3
#: Patterns that fill less of a sequence are not used; their pieces are laid end to end.
LEAST_FILL = 0.99
BUCKET_PIECES = 5_000

# The two tokenizer libraries split such texts alike; others, of rarer scripts, spaces or controls, go to the slower one.
_alike = re.compile(r"[\t\n\r -~¡-ɏ‐-‧]*")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of the byte-level BPE vocabulary in a tokenizers JSON file."""

    def __init__(self, content: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(content)
        spec = json.loads(content)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # Byte-level vocabularies write bytes as printable characters: printable Latin-1 as itself, the others from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if _alike.fullmatch(text) and not (self.special and self.special.search(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def _tokenize(content):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(content.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, crcs, rests = [], [], []
                for text in batch.column("text").to_pylist():
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    n.append(len(ids))
                    crcs.append([zlib.crc32(ids[i : i + CAPACITY].tobytes()) for i in range(0, len(ids), CAPACITY)])
                    rests.append(ids[len(ids) - len(ids) % CAPACITY :].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], ["place", "id", "tokens", "crcs", "rest"])

    return tokenize


def best_pattern(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of weights within capacity, as counts. weights ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    within = np.searchsorted(weights, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := within[c]:
            gains = values[:k] + best[c - weights[:k]]
            i = int(gains.argmax())
            if gains[i] > best[c] + 1e-12:
                best[c], choice[c] = gains[i], i
    counts, c = np.zeros(len(weights), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= weights[choice[c]]
    return float(best[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with partial pivoting."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for i in range(m):
        p = i + int(np.abs(both[i:, i]).argmax())
        both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        both -= np.outer(factors, both[i])
    return both[:, m:]


def solve_patterns(weights: np.ndarray, demand: np.ndarray, capacity: int = CLASSES, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Column generation: patterns (counts for each weight) and how often the linear program uses them, least sequences in all."""
    m = len(weights)
    if not m:
        return []
    columns = [np.where(np.arange(m) == i, capacity // weights[i], 0) for i in range(m)]
    costs, x = np.ones(m), demand / (capacity // weights)
    inverse = np.diag(1.0 / (capacity // weights))
    for step in range(200 * m + 1000):
        duals = np.einsum("i,ij->j", costs, inverse)  # einsum, as BLAS threads can block in a driver that runs a JVM
        if duals.min() < -1e-9:  # a surplus enters: more pieces of a class than there are
            column, cost = -np.eye(m)[int(duals.argmin())], 0.0
        else:
            value, counts = best_pattern(weights, np.maximum(duals, 0), capacity)
            if value <= 1 + gap:
                break
            column, cost = counts.astype(float), 1.0
        along = np.einsum("ij,j->i", inverse, column)
        able = along > 1e-9
        ratios = np.where(able, x / np.where(able, along, 1), np.inf)
        out = int(ratios.argmin())
        move = max(ratios[out], 0.0)
        x = np.maximum(x - move * along, 0)
        x[out] = move
        columns[out], costs[out] = column, cost
        row = inverse[out] / along[out]
        inverse = inverse - np.outer(along, row)
        inverse[out] = row
        if step % 1000 == 999:  # against rounding errors
            inverse = inverted(np.array(columns, float).T)
            x = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    return [(np.array(c, np.int64), float(v)) for c, v, cost in zip(columns, x, costs, strict=True) if cost > 0 and v > 0]


def rounded(weights: np.ndarray, demand: np.ndarray, patterns: list[tuple[np.ndarray, float]], capacity: int = CLASSES, least_fill: float = LEAST_FILL) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns, none asking for more pieces than there are: floors, then one more each, then greedy patterns."""
    left, out = demand.astype(np.int64).copy(), []

    def use(counts: np.ndarray, most: int) -> None:
        if counts @ weights >= least_fill * capacity:
            has = counts > 0
            n = int(min(most, (left[has] // counts[has]).min()))
            if n > 0:
                left[has] -= n * counts[has]
                out.append((counts, n))

    for counts, n in sorted(patterns, key=lambda p: (-p[1], p[0].tolist())):
        use(counts, int(n + 1e-6))
    for counts, n in sorted(patterns, key=lambda p: (-(p[1] % 1), p[0].tolist())):
        use(counts, 1)
    skip = len(weights)
    while skip > 0:  # greedy: the longest class left, then the longest that still fits
        skip -= 1
        while left[skip]:
            counts, room = np.zeros(len(weights), np.int64), capacity
            for i in range(skip, -1, -1):
                k = min(int(left[i] - counts[i]), room // int(weights[i]))
                counts[i] += k
                room -= k * int(weights[i])
            before = len(out)
            use(counts, int(left[skip]))
            if len(out) == before:
                break
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; its content is broadcast
        content = spark.sparkContext.broadcast(f.read())
    schema = f"place long, id {type_of(docs, id_column)}, tokens long, crcs array<long>, rest binary"
    source = docs.select(F.monotonically_increasing_id().alias("place"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    encoded = cut(source.mapInArrow(_tokenize(content), schema), "tokens")
    pieces = encoded.select("place", "id", "tokens", F.posexplode("crcs").alias("k", "crc"))
    pieces = pieces.select("place", "id", "tokens", (F.col("k") * CAPACITY).cast("long").alias("start"), F.least(F.lit(CAPACITY), F.col("tokens") - F.col("k") * CAPACITY).cast("long").alias("length"), "crc")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / UNIT).cast("int"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_PIECES))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("place", "start"), F.lit(buckets)).cast("int"))

    weights = np.array(sorted(c for c in histogram if c < CLASSES), np.int64)
    demand = np.array([histogram[c] for c in weights], np.int64)
    uses = rounded(weights, demand, solve_patterns(weights, demand.astype(float)))
    slots, sequences, taken = [], 0, {}
    if CLASSES in histogram:
        slots.append((CLASSES, 0, histogram[CLASSES], 1, 0))
        sequences = histogram[CLASSES]
    for counts, n in uses:
        for c, a in zip(weights.tolist(), counts.tolist(), strict=True):
            if a:
                first = taken.get(c, 0)
                slots.append((c, first, first + n * a, a, sequences))
                taken[c] = first + n * a
        sequences += n
    slotted = F.broadcast(spark.createDataFrame(slots, "class int, first long, last long, each long, base long"))  # patterns: a few for each class

    by_bucket = pieces.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    behind = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("class", "bucket", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("before"))
    inside = Window.partitionBy("class", "bucket").orderBy(F.desc("length"), "place", "start")
    ranked = pieces.withColumn("rank", F.row_number().over(inside).cast("long")).join(offsets, ["class", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    assigned = cut(
        ranked.alias("r").join(slotted.alias("s"), (F.col("r.class") == F.col("s.class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")), "left")
        .select("r.*", F.expr("base + (rank - first) div each").alias("sequence")), "assigned",
    )
    in_sequence = Window.partitionBy("sequence").orderBy(F.desc("length"), "place", "start").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.col("id").alias(id_column), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset"]
    by_pattern = assigned.where("sequence is not null").withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).select(*columns)

    # The rest, end to end. Its pieces are remainders, shorter than CAPACITY, so each is cut once at most.
    rest = assigned.where("sequence is null")
    totals = rest.groupBy("bucket").agg(F.sum("length").alias("sum"))
    earlier = totals.select("bucket", F.coalesce(F.sum("sum").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_bucket"))
    running = Window.partitionBy("bucket").orderBy("place", "start").rowsBetween(Window.unboundedPreceding, -1)
    laid = rest.withColumn("running", F.coalesce(F.sum("length").over(running), F.lit(0))).join(earlier, "bucket").withColumn("from", F.col("before_bucket") + F.col("running"))
    room = CAPACITY - F.col("from") % CAPACITY
    parts = laid.withColumn("first_length", F.least("length", room)).select(
        "*", F.explode(F.filter(F.array(F.struct(F.lit(0).cast("long").alias("skip"), F.col("first_length").alias("take")), F.struct(F.col("first_length").alias("skip"), (F.col("length") - F.col("first_length")).alias("take"))), lambda p: p["take"] > 0)).alias("part")
    )
    parts = parts.withColumn("at", F.col("from") + F.col("part.skip")).select(
        "place", "id", "tokens", (F.col("start") + F.col("part.skip")).alias("start"), F.col("part.take").alias("length"), "crc", F.col("part.skip").alias("skip"), (F.col("part.take") < F.col("length")).alias("is_cut"),
        (F.lit(sequences) + F.expr(f"at div {CAPACITY}")).alias("sequence"), (F.col("at") % CAPACITY).alias("offset"),
    )
    whole = parts.where("not is_cut").select(*columns)
    cut_parts = parts.where("is_cut").join(encoded.select("place", "rest"), "place").withColumn("crc", F.crc32(F.expr("substring(rest, cast(4 * skip + 1 as int), cast(4 * length as int))"))).select(*columns)
    return by_pattern.unionByName(whole).unionByName(cut_parts)
